"""Page layout: blocks of text with their places become body paragraphs, footnotes and margin rubrics, in reading order.

blocks: keys, block_no, block_type, x0, y0, x1, y1, font_size (may be null), text. pages: keys, w, h. dividers: keys, lx0, lx1, ly. keys name a page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import normalize as N
from quire.functions import text as T

# Marks, words and headings by which blocks are told apart.
RULE_LINE = r"(?U)^[\s_—–-]{3,}\s*$"
PAGE_NUMBER = r"(?U)^\s*[-–—]?\s*[\d٠-٩]+\s*[-–—]?\s*$"
FOOTNOTE_MARK = r"(?U)([(\[]\s*[\d٠-٩*†]+\s*[)\]]|\*|(?<![؀-ۿ])[\d٠-٩]+[\-.)]|(?<![؀-ۿ])[\d٠-٩]+\s*»|[.،]\s*[\d٠-٩]+\b)"
RUBRIC_WORDS = ("مدخل", "تمهيد", "تنبيه", "تذكرة", "إشارة", "إضاءة")
CITATION_WORDS = ("ص", "ج", "ح", "طبعة", "المصدر", "الكافي", "بحار", "وسائل")
TITLE_LABELS = ("العنوان", "عنوان", "الموضوع")
BLOCK_HEADING = r"(?U)^(?:#+|\d+[\-.)]|[-•*]\s+|[:\s]*(?:المقصد|الباب|الفصل|المبحث|المسألة|الدرس|العنوان|كلمة))"
TERMINAL = r"(?U)[.!:؟]\s*$"
LIST_END = r"(?U)[-–—.]?\s*[\d٠-٩]+[-–—.]?\s*$"
LIST_START = r"(?U)^[\s.ـ]*[-–—]?\s*[\d٠-٩]+[\-.)]"


@dataclass(frozen=True)
class Options:
    remove_headers_footers: bool = True
    separate_footnotes: bool = True
    exclude_margin_rubrics: bool = True


def share(size: str, percent: float) -> Column:
    """So many percent of a page's size. The product is exact for whole sizes, so a place on the border is on it: 600 * 0.14 is over 84."""
    return F.col(size) * F.lit(float(percent)) / 100.0


def divider_lines(lines: DataFrame, height: str = "h") -> DataFrame:
    """Of drawn lines (keys, x_a, y_a, x_b, y_b, h), those that part footnotes from the body: level, low on the page and wide. Adds lx0, lx1, ly."""
    ly = (F.col("y_a") + F.col("y_b")) / 2
    lx0, lx1 = F.least("x_a", "x_b"), F.greatest("x_a", "x_b")
    out = lines.where((F.abs(F.col("y_a") - F.col("y_b")) < 2) & (ly > share(height, 55)) & (lx1 - lx0 > 35))
    return out.select(*[c for c in lines.columns if c not in ("x_a", "y_a", "x_b", "y_b", height)], lx0.alias("lx0"), lx1.alias("lx1"), ly.alias("ly"))


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    return F.lit(False) if not words else x.rlike("|".join(words))


def below_divider(blocks: DataFrame, dividers: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks under a divider of their column: a range join, kept as a semi-join."""
    d = dividers.select(*[F.col(k).alias(f"__{k}") for k in keys], "lx0", "lx1", "ly")
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    on += [F.col("y0") >= F.col("ly") - 4, ~((F.col("x1") < F.col("lx0") - 15) | (F.col("x0") > F.col("lx1") + 15))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return blocks.join(d, cond, "left_semi")


def classify(blocks: DataFrame, pages: DataFrame, dividers: DataFrame | None = None, keys: tuple[str, ...] = ("page_id",), options: Options = Options(), normalize: bool = True) -> DataFrame:
    """keys, block_no, text, kind (body, footnote, rubric, margin for headers, footers), ord (reading order), multi_column. One shuffle, by page."""
    keys = list(keys)
    page = Window.partitionBy(*keys)
    rows = blocks.join(pages, keys)
    in_body = (F.col("y0") > share("h", 15)) & (F.col("y0") < share("h", 65)) & (F.col("font_size") > 0)
    rows = rows.withColumn("__typical", F.coalesce(F.avg(F.when(in_body, F.col("font_size"))).over(page), F.lit(0.0)))
    text = N.normalize(T.strip("text")) if normalize else T.strip("text")
    rows = rows.where("block_type = 0").withColumn("text", text).where((F.col("text") != "") & ~F.col("text").rlike(RULE_LINE))
    margin = F.lit(options.remove_headers_footers) & ((F.col("y1") < share("h", 7.5)) | ((F.col("y0") > share("h", 92.5)) & F.col("text").rlike(PAGE_NUMBER)))
    ribbon = ((F.col("y1") - F.col("y0")) > 1.8 * (F.col("x1") - F.col("x0"))) & ((F.col("y1") - F.col("y0")) > 35)
    outer = (F.col("x0") > share("w", 86)) | (F.col("x1") < share("w", 14))
    rubric = F.lit(options.exclude_margin_rubrics) & outer & (ribbon | contains_any(F.col("text"), RUBRIC_WORDS))
    rows = rows.withColumn("__margin", margin).withColumn("__rubric", rubric)
    if dividers is not None and options.separate_footnotes:
        # a page's few dividers go to its blocks in an array: a join by block would compute, sort and move all blocks twice
        lines = dividers.groupBy(*keys).agg(F.collect_list(F.struct("lx0", "lx1", "ly")).alias("__lines"))
        under = F.exists("__lines", lambda d: (F.col("y0") >= d["ly"] - 4) & ~((F.col("x1") < d["lx0"] - 15) | (F.col("x0") > d["lx1"] + 15)))
        rows = rows.join(lines, keys, "left").withColumn("__under", F.coalesce(under, F.lit(False))).withColumn("__lined", F.col("__lines").isNotNull()).drop("__lines")
    else:
        rows = rows.withColumn("__under", F.lit(False)).withColumn("__lined", F.lit(False))
    right = F.bool_or((F.col("x0") > share("w", 50)) & (F.col("x1") > share("w", 70))).over(page)
    left = F.bool_or((F.col("x1") < share("w", 50)) & (F.col("x0") < share("w", 30))).over(page)
    across = F.bool_or((F.col("x0") < share("w", 25)) & (F.col("x1") > share("w", 75))).over(page)
    rows = rows.withColumn("multi_column", (F.count("*").over(page) >= 4) & right & left & ~across)
    # columns from the right, each downward; or bands of 12 points, each from the right
    first = F.when(F.col("multi_column"), F.when(F.col("x0") > share("w", 45), 0.0).otherwise(1.0)).otherwise(F.bround(F.col("y0") / 12.0, 0))
    second = F.when(F.col("multi_column"), F.col("y0")).otherwise(-F.col("x0"))
    # the order's parts are columns, so that both windows share one sort
    rows = rows.withColumn("__first", first).withColumn("__second", second)
    order = Window.partitionBy(*keys).orderBy("__first", "__second", "block_no")
    marked = F.substring("text", 1, 25).rlike(FOOTNOTE_MARK) | F.when(F.length("text") > 25, F.substring(F.col("text"), F.length("text") - 24, F.lit(25)).rlike(FOOTNOTE_MARK)).otherwise(False)
    size = F.coalesce("font_size", F.lit(12.0))
    citation = (F.col("__typical") > 13) & (size > 0) & (size < F.col("__typical") * 0.8) & contains_any(F.col("text"), CITATION_WORDS)
    candidate = F.lit(options.separate_footnotes) & ~F.col("__lined") & ~F.col("__under") & ~F.col("__margin") & ~F.col("__rubric") & (F.col("y0") > share("h", 65))
    rows = rows.withColumn("__hit", candidate & (marked | citation)).withColumn("__may", candidate)
    earlier = F.max("__hit").over(order.rowsBetween(Window.unboundedPreceding, -1))
    note = F.col("__under") | F.col("__hit") | (F.col("__may") & ~F.col("multi_column") & F.coalesce(earlier, F.lit(False)))
    rows = rows.withColumns({"ord": F.row_number().over(order), "__note": note})
    kind = F.when(F.col("__rubric"), "rubric").when(F.col("__margin"), "margin").when(F.col("__note"), "footnote").otherwise("body")
    return rows.select(*keys, "block_no", "text", kind.alias("kind"), "ord", "multi_column")


def merge(blocks: Column) -> Column:
    """array<string>: paragraphs that line or page breaks had cut, joined again."""
    texts = F.filter(F.transform(blocks, T.strip), lambda b: b != "")

    def step(done: Column, b: Column) -> Column:
        prev = F.element_at(done, -1)
        rest = F.slice(done, 1, F.size(done) - 1)
        label = prev.isin(*TITLE_LABELS) & (F.length(b) < 60)
        closed = prev.rlike(TERMINAL) | prev.rlike(LIST_END)
        heading = prev.rlike(BLOCK_HEADING) | ((F.length(prev) < 40) & ~F.endswith(prev, F.lit(".")) & ~F.endswith(prev, F.lit("،")))
        joins = ~closed & ~heading & ~b.rlike(BLOCK_HEADING) & ~b.rlike(LIST_START)
        return (
            F.when(F.size(done) == 0, F.array(b))
            .when(label, F.concat(rest, F.array(F.concat(prev, F.lit(": "), b))))
            .when(joins, F.concat(rest, F.array(F.concat(prev, F.lit(" "), b))))
            .otherwise(F.concat(done, F.array(b)))
        )

    # element_at fails on an empty array, so the fold begins with the first block
    return F.when(F.size(texts) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), F.slice(texts, 1, 1), step))


def page_texts(classified: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keys, body, footnotes, rubrics: arrays in reading order; rubrics without spaces and once each."""
    of = lambda k: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("ord", "kind", "text"))), lambda b: b["kind"] == k), lambda b: b["text"])
    rows = classified.groupBy(*keys).agg(of("body").alias("body"), of("footnote").alias("footnotes"), of("rubric").alias("rubrics"))
    plain = F.transform("rubrics", lambda r: F.regexp_replace(r, "[ـ \n\r\t]", ""))
    return rows.select(*keys, merge(F.col("body")).alias("body"), "footnotes", F.array_distinct(F.filter(plain, lambda r: r != "")).alias("rubrics"))


def document_text(pages: DataFrame, keys: tuple[str, ...], page: str, note_header: str = "[الهوامش والتعليقات / Page Footnotes]") -> DataFrame:
    """One text for each document (keys): pages by number, rubrics as comments before a page's first paragraph, footnotes under a heading."""
    comments = F.array_join(F.transform("rubrics", lambda r: F.concat(F.lit("<!-- rubric: "), r, F.lit(" -->"))), "\n")
    body = F.when((F.size("rubrics") > 0) & (F.size("body") > 0), F.concat(F.array(F.concat(comments, F.lit("\n"), F.element_at("body", 1))), F.slice("body", F.lit(2), F.size("body")))).otherwise(F.col("body"))
    notes = F.when(F.size("footnotes") > 0, F.concat(F.array(F.lit(note_header)), F.col("footnotes"))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(body, notes), "\n\n")
    rows = pages.select(*keys, F.col(page).alias("__page"), text.alias("__text")).where("__text != ''")
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__page", "__text"))), lambda p: p["__text"]), "\n\n").alias("text"))
