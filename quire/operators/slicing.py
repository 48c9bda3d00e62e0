"""Pages and chapters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.chunking import ARABIC, Profile

WORDS_PER_PAGE = 350


def page_range(spec: str | None = None, skip: int | None = None, take: int | None = None) -> tuple[int, int | None]:
    """(pages skipped, pages taken; None: to the end) of 10-25, 10:25, 10:, :20 or 5, or else of skip and take."""
    if not spec:
        return max(0, skip or 0), None if take is None else max(1, take)
    text = spec.strip()
    if m := re.fullmatch(r"(\d+)\s*[-:]\s*(\d+)", text):
        first, last = int(m[1]), int(m[2])
        if first > last:
            raise ValueError(f"page {first} is after page {last}: {spec!r}")
        return max(0, first - 1), max(1, last - first + 1)
    if m := re.fullmatch(r"(\d+)\s*[-:+]", text):
        return max(0, int(m[1]) - 1), None
    if m := re.fullmatch(r"[-:]\s*(\d+)", text):
        return 0, max(1, int(m[1]))
    if text.isdigit():
        return max(0, int(text) - 1), 1
    raise ValueError(f"no page range: {spec!r}; try 10-25, 10:, :20 or 5")


def page_range_columns(spec: Column | str, skip: Column | str, take: Column | str) -> tuple[Column, Column, Column]:
    """The same over rows: (skip, take, error)."""
    text = T.strip(spec)
    both, opened, upto, one = r"(?U)^(\d+)\s*[-:]\s*(\d+)$", r"(?U)^(\d+)\s*[-:+]$", r"(?U)^[-:]\s*(\d+)$", r"(?U)^(\d+)$"
    n = lambda p, g: F.regexp_extract(text, p, g).try_cast("int")
    at_least = lambda x, least: F.greatest(F.lit(least), x)
    given = text != ""
    bad = given & ~(text.rlike(both) & (n(both, 1) <= n(both, 2)) | text.rlike(opened) | text.rlike(upto) | text.rlike(one))
    skipped = F.when(text.rlike(both), at_least(n(both, 1) - 1, 0)).when(text.rlike(opened), at_least(n(opened, 1) - 1, 0)).when(text.rlike(upto), 0).when(text.rlike(one), at_least(n(one, 1) - 1, 0))
    taken = F.when(text.rlike(both), at_least(n(both, 2) - n(both, 1) + 1, 1)).when(text.rlike(upto), at_least(n(upto, 1), 1)).when(text.rlike(one), 1)
    skip, take = T.col(skip), T.col(take)
    none = F.lit(None).cast("int")
    return F.when(bad, none).when(given, skipped).otherwise(at_least(F.coalesce(skip, F.lit(0)), 0)), F.when(bad, none).when(given, taken).when(take.isNotNull(), at_least(take, 1)), bad


def pages(x: Column | str, words_per_page: int = WORDS_PER_PAGE) -> Column:
    """array<string>: parts between form feeds, or of so many words."""
    text = T.text_of(x)
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def by_words(w: Column) -> Column:
        n = F.ceil(F.size(w) / F.lit(words_per_page)).cast("int")
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, (i - 1) * words_per_page + 1, words_per_page), " ")))

    return F.when(text.contains("\f"), F.split(text, "\f")).otherwise(F.element_at(F.transform(F.array(words), by_words), 1))


def slice_pages(x: Column | str, skip: int = 0, take: int | None = None, words_per_page: int = WORDS_PER_PAGE) -> Column:
    """Pages joined by a blank line. Skipping all pages of a text is an error."""
    skip = max(0, skip)

    def cut(p: Column) -> Column:
        some = F.slice(p, skip + 1, take) if take is not None else F.slice(p, F.lit(skip + 1), F.greatest(F.size(p), F.lit(1)))
        return F.when(F.size(p) <= skip, F.raise_error(F.format_string("%d pages skipped of a text of %d", F.lit(skip), F.size(p))).cast("string")).otherwise(F.array_join(some, "\n\n"))

    return F.when(T.text_of(x) == "", "").otherwise(F.element_at(F.transform(F.array(pages(x, words_per_page)), cut), 1))


CHAPTER = "array<struct<idx:int,title:string,char_start:int,char_end:int,word_count:int>>"


def chapters(x: Column | str, profile: Profile = ARABIC) -> Column:
    """array<struct<idx, title, char_start, char_end, word_count>>: from a heading's line to the next."""
    pattern = rf"(?U)^[ \t]*{profile.heading}"
    text = T.text_of(x)
    lines = F.split(text, "\n")
    starts = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,title:string>>").alias("found")),
        lambda s, line: F.struct(
            (s["at"] + F.length(line) + 1).alias("at"),
            F.when(line.rlike(pattern), F.concat(s["found"], F.array(F.struct(s["at"].alias("start"), T.strip(line).alias("title"))))).otherwise(s["found"]).alias("found"),
        ),
        lambda s: s["found"],
    )

    def each(found: Column) -> Column:
        end = lambda i: F.when(i + 1 < F.size(found), F.get(found, i + 1)["start"]).otherwise(F.length(text))
        words = lambda c, i: F.size(F.filter(F.split(F.substring(text, c["start"] + 1, end(i) - c["start"]), r"(?U)\s+"), lambda w: w != ""))
        return F.transform(found, lambda c, i: F.struct((i + 1).alias("idx"), c["title"].alias("title"), c["start"].alias("char_start"), end(i).alias("char_end"), words(c, i).alias("word_count")))

    return F.element_at(F.transform(F.array(starts), each), 1)


def chapter_rows(docs: DataFrame, text: str = "text", profile: Profile = ARABIC) -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.inline(chapters(text, profile)))


def extract_chapter(docs: DataFrame, query: str | int, text: str = "text", profile: Profile = ARABIC) -> DataFrame:
    """Each document's one chapter by number, or by part of its title in any case: its other columns, idx, title, chapter_text. None or several are an error."""
    wanted = str(query).strip()
    hit = (lambda c: c["idx"] == int(wanted)) if wanted.isdigit() else (lambda c: F.contains(F.lower(c["title"]), F.lit(wanted.lower())))
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.col(text).alias("__text"), F.filter(chapters(text, profile), hit).alias("__hits"))
    one = F.when(F.size("__hits") == 1, F.element_at("__hits", 1)).otherwise(F.raise_error(F.format_string(f"%d chapters fit {wanted}", F.size("__hits"))).cast("struct<idx:int,title:string,char_start:int,char_end:int,word_count:int>"))
    rows = rows.select(*keep, "__text", one.alias("c"))
    return rows.select(*keep, "c.idx", "c.title", T.strip(F.substring(F.col("__text"), F.col("c.char_start") + 1, F.col("c.char_end") - F.col("c.char_start"))).alias("chapter_text"))
