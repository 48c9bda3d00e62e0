"""Runs that can be resumed, and books done slice by slice: checkpoints, footnote numbers, trailing context and progress."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import slicing, translate
from quire.operators.chunking import ARABIC, Profile, chunk_documents
from quire.operators.translate import Config
from quire.sources import store

# References and definitions of footnotes, and the headings under which they stand.
REFERENCE = r"\[\^?(\d+)\]"
NOTE_SECTION = r"\n(?:> )?\[(?:الهوامش والتعليقات|Page Footnotes|Noter og kommentarer)[\s\S]*$"
DEFAULT_PAGES = 10


def compatible(checkpoint: DataFrame, run: DataFrame) -> DataFrame:
    """run's rows (source_hash, total_chunks, target_lang, domain, inline_arabic, verify and others) with `compatible`: a checkpoint has the same six."""
    keys = ["source_hash", "total_chunks", "__lang", "__domain", "inline_arabic", "verify"]
    lower = {"__lang": F.lower("target_lang"), "__domain": F.lower("domain")}
    same = checkpoint.withColumns(lower).select(*[F.col(k).alias(f"__same_{k}") for k in keys], F.lit(True).alias("compatible")).distinct()
    # null-safe, as an equal join asks both sides for keys that aren't null, and each condition on a hash makes the optimizer cut and hash the texts once more; a null is told below
    out = run.withColumns(lower).join(same, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in keys]), "left")
    told = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return out.select(*run.columns, (F.coalesce("compatible", F.lit(False)) & told).alias("compatible"))


def remaining(chunks: DataFrame, done: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks that an earlier run did not finish."""
    return chunks.join(done.select(*by, "chunk_index").distinct(), [*by, "chunk_index"], "left_anti")


def completed_prefix(chunks: DataFrame, done: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """by, next_index: the first chunk that is not done; everything before it is. Chunks are computed once."""
    marked = chunks.join(done.select(*by, "chunk_index", F.lit(True).alias("__done")).distinct(), [*by, "chunk_index"], "left")
    first = F.min(F.when(F.col("__done").isNull(), F.col("chunk_index")))
    return marked.groupBy(*by).agg(F.coalesce(first, F.count("*").cast("int")).alias("next_index"))


def offset_footnotes(x: Column | str, offset: Column | int) -> Column:
    """struct<text, max>: footnote definitions and [^n] references moved up; max is the highest number after it. An offset of 0 or less changes nothing."""
    text, by = T.text_of(x), F.lit(offset).cast("bigint") if isinstance(offset, int) else offset.cast("bigint")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda n: n.cast("bigint"))
    highest = F.coalesce(F.array_max(numbers), F.lit(0).cast("bigint"))
    # a definition at a line's start, or a reference that no colon follows
    mark = r"(?m)(?:^\[\^?\d+\]:|\[\^\d+\](?!:))"
    marks = F.regexp_extract_all(text, F.lit(mark), F.lit(0))
    moved = F.transform(marks, lambda m: F.regexp_extract(m, r"(\d+)", 1).cast("bigint") + by)
    new = F.zip_with(marks, moved, lambda m, n: F.concat(F.lit("[^"), n.cast("string"), F.when(F.endswith(m, F.lit(":")), "]:").otherwise("]")))
    out = F.array_join(F.flatten(F.zip_with(F.split(text, mark), new, lambda p, m: F.array(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit(""))))), "")
    return F.when(by <= 0, F.struct(text.alias("text"), highest.alias("max"))).otherwise(F.struct(out.alias("text"), F.greatest(by, F.coalesce(F.array_max(moved), F.lit(0).cast("bigint"))).alias("max")))


def inspect(x: Column | str) -> Column:
    """struct<max_footnote, trailing_source, trailing_target>: what the next slice needs to know of a finished document."""
    text = T.text_of(x)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda n: n.cast("bigint"))
    lines = F.reverse(F.transform(F.split(T.strip(F.regexp_replace(text, f"(?iU){NOTE_SECTION}", "")), "\n"), T.strip))
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("mode"), empty.alias("source"), empty.alias("target"))  # 0 target, 1 source, 2 over

    def step(s: Column, line: Column) -> Column:
        quote = F.startswith(line, F.lit(">"))
        over = (s["mode"] == 2) | ((line == "") & (s["mode"] == 1))
        mode = F.when(over, 2).when(quote, 1).otherwise(s["mode"])
        source = F.when(~over & quote, F.concat(F.array(T.strip(F.regexp_replace(line, "^[> ]+", ""))), s["source"])).otherwise(s["source"])
        target = F.when(~over & ~quote & (line != "") & (s["mode"] == 0), F.concat(F.array(line), s["target"])).otherwise(s["target"])
        return F.struct(mode.alias("mode"), source.alias("source"), target.alias("target"))

    def close(s: Column) -> Column:
        return F.struct(F.coalesce(F.array_max(numbers), F.lit(0).cast("bigint")).alias("max_footnote"), T.strip(F.array_join(s["source"], " ")).alias("trailing_source"), T.strip(F.array_join(s["target"], " ")).alias("trailing_target"))

    return F.aggregate(lines, start, step, close)


def slice_marker(start: int, end: int) -> str:
    return f"<!-- slice: p{start}-{end} -->"


def append_slices(slices: DataFrame, by: tuple[str, ...] = ("project",)) -> DataFrame:
    """by, document: slices (seq, start_page, end_page, text) in order, each but the first led by its marker."""
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "start_page", "end_page", T.strip("text").alias("text")))),
        lambda s, i: F.when(i == 0, s["text"]).otherwise(F.concat(F.lit("\n\n<!-- slice: p"), s["start_page"].cast("string"), F.lit("-"), s["end_page"].cast("string"), F.lit(" -->\n\n"), s["text"])),
    )
    return slices.groupBy(*by).agg(F.concat(F.array_join(parts, ""), F.lit("\n")).alias("document"))


def progress(slices: DataFrame, projects: DataFrame, by: str = "project") -> DataFrame:
    """by, pages_done (repeats counted), distinct_pages, percent (null without a total), slices, next_page. projects: by, total_pages, next_page."""
    each = slices.groupBy(by).agg(
        F.sum(F.col("end_page") - F.col("start_page") + 1).alias("pages_done"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("start_page", "end_page"))))).cast("bigint").alias("distinct_pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start_page", "end_page"))), lambda s: F.concat(F.lit("p"), s["start_page"].cast("string"), F.lit("-"), s["end_page"].cast("string"))), ", ").alias("slices"),
    )
    out = projects.join(each, by, "left")
    done = F.coalesce("pages_done", F.lit(0).cast("bigint"))
    return out.select(by, done.alias("pages_done"), F.coalesce("distinct_pages", F.lit(0).cast("bigint")).alias("distinct_pages"), F.when(F.col("total_pages") > 0, F.round(done * 100.0 / F.col("total_pages"), 1)).alias("percent"), F.coalesce("slices", F.lit("None")).alias("slices"), "next_page")


@dataclass(frozen=True)
class Slice:
    start_page: int
    end_page: int
    char_count: int = 0
    completed_at: str = ""


@dataclass(frozen=True)
class Project:
    """A book's manifest: a JSON file, written under another name and renamed, so that it is the old one or the new one at any time."""

    name: str
    source: str
    target_lang: str = "en"
    domain: str = "mantiq"
    bilingual: bool = True
    total_pages: int | None = None
    next_page: int = 1
    max_footnote: int = 0
    trailing_source: str = ""
    trailing_target: str = ""
    document: str = ""
    slices: tuple[Slice, ...] = field(default_factory=tuple)

    def save(self, spark: SparkSession, path: str) -> None:
        folder, _, name = path.rpartition("/")
        store.Folder(spark, folder or ".").save(name, asdict(self))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Project:
        data = json.loads(spark.read.text(path, wholetext=True).first()[0])
        known = Project.__dataclass_fields__
        return Project(**{k: v for k, v in data.items() if k in known and k != "slices"}, slices=tuple(Slice(**s) for s in data.get("slices", ())))


def adopt(project: Project, document: str, through_page: int, spark: SparkSession) -> Project:
    """A project that goes on where an existing bilingual document ends."""
    seen = spark.createDataFrame([(document,)], "t string").select(inspect("t").alias("i")).first().i
    return replace(project, document=document, next_page=through_page + 1, max_footnote=seen.max_footnote, trailing_source=seen.trailing_source, trailing_target=seen.trailing_target)


def page_window(project: Project, pages: str | None = None, take: int | None = None, all_pages: bool = False) -> tuple[int, int]:
    """First and last page of the next slice: all that are left, given ones, so many, or the next ten."""
    first = last = project.next_page
    if all_pages:
        last = project.total_pages or first
    elif pages:
        skip, n = slicing.page_range(pages)
        first = skip + 1
        last = first + (n or 1) - 1
    elif take and take > 0:
        last = first + take - 1
    else:
        left = project.total_pages - first + 1 if project.total_pages else DEFAULT_PAGES
        last = first + max(1, min(DEFAULT_PAGES, left)) - 1
    if project.total_pages:
        last = min(last, project.total_pages)
    if first > last:
        raise ValueError(f"page {first} is after page {last}")
    return first, last


def continue_project(spark: SparkSession, project: Project, text: str, cfg: Config, pages: str | None = None, take: int | None = None, all_pages: bool = False, provider: translate.Provider | None = None, profile: Profile = ARABIC, now: str | None = None, glossary: str = "", **options) -> Project:
    """One more slice of a book: its pages are cut, chunked with the end of the slice before as context, translated (dry, without a provider), renumbered and appended. options: of translate_run()."""
    first, last = page_window(project, pages, take, all_pages)
    book = spark.createDataFrame([(1, text, project.trailing_source)], "doc_id bigint, text string, before string")
    part = book.select("doc_id", slicing.slice_pages("text", first - 1, last - first + 1).alias("text"), "before")
    cfg = replace(cfg, target_lang=project.target_lang, domain=project.domain, bilingual=project.bilingual)
    chunks = chunk_documents(part, "text", cfg.chunk_size, cfg.overlap, "before", profile)
    if provider is None:
        done = translate.dry_run(chunks, cfg)
    else:
        done = translate.translate_run(chunks, provider, cfg, glossary=glossary, **options).outputs
    out = translate.join_outputs(done).select(offset_footnotes("output", project.max_footnote).alias("o"))
    row = out.select("o.text", "o.max", inspect("o.text").alias("i")).first()
    size = part.select(F.length("text")).first()[0]
    new = (row.text if row else "").strip()
    document = f"{project.document.rstrip()}\n\n{slice_marker(first, last)}\n\n{new}\n" if project.document.strip() else f"{new}\n"
    return replace(
        project,
        document=document,
        next_page=last + 1,
        max_footnote=row.max if row else project.max_footnote,
        trailing_source=(row.i.trailing_source if row else "") or project.trailing_source,
        trailing_target=(row.i.trailing_target if row else "") or project.trailing_target,
        slices=(*project.slices, Slice(first, last, size, now or datetime.now().isoformat())),
    )
