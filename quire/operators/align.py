"""Source and target paragraphs: splitting, tags, pairing, bilingual Markdown and its audit. All but consolidation are expressions over one row."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import text as T

# Comments that name a rubric, titles of sections, the heading of footnotes, and translations that say nothing.
RUBRIC = r"^<!--\s*rubric:\s*.*?\s*-->$"
SECTION = (
    r"^(?:الدرس|المبحث|المطلب|المقصد|الباب|الفصل|المرحلة|المسألة|أولاً|ثانياً|ثالثاً|رابعاً|خامساً)\s*"
    r"(?:الأول|الثاني|الثالث|الرابع|الخامس|السادس|السابع|الثامن|التاسع|العاشر|الحادي|الثاني|الثالث|\d+)?"
)
NOTES = r"\[الهوامش والتعليقات\s*/\s*Page Footnotes\]"
DUMMIES = (".", "•", "-", "..", "...", "[P", "[", "]")
LEAK = r"^\s*(?:Wait[!,]|Let'?s\s+see|Look\s+at\s+what|In\s*,\s*|Can\s+we\s+present)\b"
PAIR = "struct<source:string,target:string>"


def once(x: Column, use) -> Column:
    """use(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def paragraphs(x: Column | str) -> Column:
    """array<string>: parts between blank lines. A rubric comment goes before the next paragraph (the last of several), or before the last one at the end."""
    parts = F.filter(F.transform(F.split(T.strip(x), r"(?U)\n\s*\n+"), T.strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(s: Column, p: Column) -> Column:
        rubric = p.rlike(rf"(?iU){RUBRIC}")
        return F.struct(F.when(rubric, s["done"]).otherwise(F.concat(s["done"], F.array(F.concat(s["held"], p)))).alias("done"), F.when(rubric, F.concat(p, F.lit("\n"))).otherwise("").alias("held"))

    def close(s: Column) -> Column:
        last = F.concat(F.slice(s["done"], F.lit(1), F.greatest(F.size(s["done"]) - 1, F.lit(0))), F.array(F.concat(s["held"], F.element_at(s["done"], -1))))
        return F.when((s["held"] != "") & (F.size(s["done"]) > 0), last).otherwise(s["done"])

    return F.aggregate(parts, start, step, close)


def tagged(x: Column | str) -> Column:
    """A text whose paragraphs are led by [P1], [P2], ..."""
    return F.array_join(F.transform(paragraphs(x), lambda p, i: F.concat(F.lit("[P"), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n")


def tags(x: Column | str) -> Column:
    """array<struct<idx, content>> by idx: what follows each tag, if not blank; of equal tags the last."""
    text = T.text_of(x)
    pattern = f"(?iU){T.TAG}"
    numbers = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b")), lambda p: F.when(p["a"] != "", p["a"]).otherwise(p["b"]).cast("bigint"))
    pieces = F.split(text, pattern)
    contents = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(numbers, contents, lambda n, c: F.struct(n.alias("idx"), T.strip(c).alias("content"))), lambda p: (p["content"] != "") & p["idx"].isNotNull())

    def last(all_: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(F.transform(all_, lambda p: p["idx"]))), lambda i: F.element_at(F.filter(all_, lambda p: p["idx"] == i), -1))

    return once(pairs, last)


def missing_tags(source: Column | str, target: Column | str) -> Column:
    """array<int>: numbers of source paragraphs without a tag in the target; none if the target has no tags at all."""

    def missing(found: Column) -> Column:
        n = F.size(paragraphs(T.clean_tags(source)))
        every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(F.filter(every, lambda i: ~F.exists(found, lambda t: t["idx"] == i)))

    return once(tags(target), missing)


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("source"), b.alias("target"))


def _proportional(many: Column, few: Column, build) -> Column:
    """Each of `few` with its run of `many`: run i ends at round((i + 1) * ratio), half to even, with at least one left for each that follows."""
    n, m = F.size(few), F.size(many)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PAIR}>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        wanted = F.when(i < n - 1, F.bround((i + 1).cast("double") * (m.cast("double") / n), 0).cast("int")).otherwise(m)
        end = F.greatest(s["at"] + 1, F.least(wanted, m - (n - 1 - i)))
        run = F.array_join(F.slice(many, s["at"] + 1, end - s["at"]), "\n\n")
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(build(F.get(few, i), run))).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["out"])


def pairs_of(source: Column, target: Column) -> Column:
    """array<struct<source, target>> of two arrays of paragraphs."""
    none = F.lit("")
    return (
        F.when(F.size(source) == F.size(target), F.zip_with(source, target, _pair))
        .when(F.size(source) == 0, F.transform(target, lambda t: _pair(none, t)))
        .when(F.size(target) == 0, F.transform(source, lambda s: _pair(s, none)))
        .when(F.size(source) < F.size(target), _proportional(target, source, _pair))
        .otherwise(_proportional(source, target, lambda few, run: _pair(run, few)))
    )


def pair_paragraphs(source: Column | str, target: Column | str, sanitize: bool = True) -> Column:
    """array<struct<source, target>>: by tags if the target has them, else by order and number. sanitize: without the lines of a model's answer in which it talks to itself; not for texts in which such lines are text."""

    def by_tags(found: Column) -> Column:
        def build(own: Column) -> Column:
            content = lambda i: F.coalesce(F.element_at(F.concat(F.transform(F.filter(found, lambda t: t["idx"] == i), lambda t: t["content"]), F.array(F.lit(""))), 1), F.lit(""))
            first = F.transform(own, lambda p, i: _pair(p, T.clean_tags(content(i + 1))))
            more = F.transform(F.filter(found, lambda t: t["idx"] > F.size(own)), lambda t: _pair(F.lit(""), T.clean_tags(t["content"])))
            return F.concat(first, more)

        return once(paragraphs(T.clean_tags(source)), build)

    def build(clean: Column) -> Column:
        untagged = once(F.struct(paragraphs(T.clean_tags(source)).alias("s"), paragraphs(T.clean_tags(clean)).alias("t")), lambda p: pairs_of(p["s"], p["t"]))
        return once(tags(clean), lambda found: F.when(F.size(found) > 0, by_tags(found)).otherwise(untagged))

    return once(T.sanitize(target) if sanitize else T.text_of(target), build)


def quoted(x: Column) -> Column:
    return F.concat(F.lit("> "), F.regexp_replace(x, "\n", "\n> "))


def quoted_pairs(source: Column | str, target: Column | str, strip_vowels: bool = True, keep_shaddah: bool = False) -> Column:
    """Source paragraphs as quotes, each with its translation."""
    text = T.strip_vowels(source, keep_shaddah) if strip_vowels else T.text_of(source)

    def block(p: Column) -> Column:
        own, other = T.clean_tags(p["source"]), T.clean_tags(p["target"])
        return F.concat_ws("\n\n", F.when(own != "", quoted(own)), F.when(other != "", other))

    blocks = F.filter(F.transform(pair_paragraphs(text, target), block), lambda b: b != "")
    return F.array_join(blocks, "\n\n")


def with_bilingual_markdown(rows: DataFrame, source: str, target: str, out: str = "output", strip_vowels: bool = True, keep_shaddah: bool = False, min_chars: int = 250) -> DataFrame:
    """rows with `out`: quoted pairs, consolidated. An operator of its own, as the optimizer can't hand this nested an expression to a Python function."""
    raw = rows.withColumn(out, quoted_pairs(source, target, strip_vowels, keep_shaddah))
    at = raw.columns.index(out)

    def run(batches):
        for batch in batches:
            done = pa.array([consolidated(t, min_chars) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([done if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return raw.mapInArrow(run, raw.schema)


# consolidation: a fold whose state resets on what it has gathered


def _kind(block: str) -> str:
    if block.startswith("<!-- slice:"):
        return "slice"
    if block.startswith("#"):
        return "heading"
    if re.search(NOTES, block, re.I):
        return "notes"
    if block.startswith("[^") and "]:" in block:
        return "note"
    return "quote" if block.startswith(">") else "text"


def _opens_section(text: str) -> bool:
    text = text.strip()
    return text.startswith("#") or bool(re.search(NOTES, text, re.I)) or (len(text) < 60 and bool(re.match(SECTION, text)))


def _render(source: str, target: str) -> str:
    quote = "\n".join(f"> {line}" for line in source.split("\n"))
    return f"{quote}\n\n{target}" if target else quote


class _Gathered:
    """Short pairs waiting to be joined."""

    def __init__(self, out: list[str]):
        self.out, self.source, self.target = out, [], []

    def flush(self) -> None:
        if self.source:
            self.out.append(_render(" ".join(self.source).strip(), " ".join(t for t in map(str.strip, self.target) if t and t not in DUMMIES).strip()))
        self.source, self.target = [], []

    def add(self, source: str, target: str, least: int) -> None:
        self.source.append(source)
        if target and target not in DUMMIES:
            self.target.append(target)
        size, ended = sum(map(len, self.source)), re.search(r"[.!:؟]\s*$", source.strip())
        if self.target and (size >= least and ended or size >= int(least * 1.9)):
            self.flush()


def consolidated(markdown: str | None, min_chars: int = 250) -> str:
    """Neighbouring short pairs joined until their source has min_chars and ends a sentence, or is much longer; headings and other blocks stand between."""
    if not markdown:
        return ""
    blocks = [b.strip() for b in markdown.split("\n\n")]
    out: list[str] = []
    held, i = _Gathered(out), 0
    while i < len(blocks):
        block, i = blocks[i], i + 1
        if not block:
            continue
        if _kind(block) != "quote":
            held.flush()
            out.append(block)
            continue
        source = "\n".join(line.lstrip("> ").strip() for line in block.splitlines()).strip()
        target = ""
        if i < len(blocks) and not blocks[i].startswith((">", "#", "<!--")) and _kind(blocks[i]) != "note":
            target, i = blocks[i], i + 1
        if _opens_section(source):
            held.flush()
            out.append(_render(source, target))
        elif not (source in ("•", "-") and target in ("•", "-", "")):
            held.add(source, target, min_chars)
    held.flush()
    return "\n\n".join(out) + "\n"


def consolidate(x: Column | str, min_chars: int = 250) -> Column:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: consolidated(t, min_chars))

    return run(T.text_of(x))


ISSUE = "struct<severity:string,type:string,line:int,description:string>"


def audit(x: Column | str) -> Column:
    """array<struct<severity, type, line, description>>: quotes without a translation, translations that say nothing, source text in list items, lines in which a model talks to itself."""
    blocks = F.split(T.text_of(x), "\n\n")
    lines_of = lambda b: F.split(b, "\n")
    issue = lambda s, t, line, d: F.struct(F.lit(s).alias("severity"), F.lit(t).alias("type"), line.cast("int").alias("line"), d.alias("description"))
    none = F.array().cast(f"array<{ISSUE}>")
    start = F.struct(F.lit(1).alias("line"), F.lit(False).alias("quote"), F.lit(0).alias("at"), none.alias("issues"))

    def of_lines(b: Column, line: Column) -> Column:
        def each(text: Column, i: Column) -> Column:
            text = T.strip(text)
            at = line + i
            bullet = text.rlike(r"^[-*•] ") & text.rlike(f"[{T.ARABIC}]{{4,}}")
            short = F.substring(text, 1, 50)
            return F.concat(
                F.when(bullet, F.array(issue("ERROR", "bidi_bullet_hazard", at, F.format_string("Source text in a list item at line %d: '%s'", at, short)))).otherwise(none),
                F.when(text.rlike(f"(?iU){LEAK}"), F.array(issue("WARNING", "llm_monologue_leak", at, F.format_string("A model talks to itself at line %d: '%s'", at, short)))).otherwise(none),
            )

        return F.flatten(F.transform(lines_of(b), each))

    def step(s: Column, raw: Column) -> Column:
        b = T.strip(raw)
        n = F.when(b == "", 1).otherwise(F.size(lines_of(b)))
        plain = T.strip(F.array_join(F.transform(lines_of(b), lambda t: T.strip(F.regexp_replace(t, r"^[> ]+", ""))), "\n"))
        apart = b.rlike(r"^(?:<!--|#|\[\^)") | b.rlike(f"(?iU){NOTES}") | ((F.length(plain) < 60) & plain.rlike(f"(?U){SECTION}"))
        quote = F.startswith(b, F.lit(">"))
        orphan = F.when(s["quote"], F.array(issue("ERROR", "orphaned_arabic_block", s["at"], F.format_string("Quotes without a translation between them near line %d", s["at"])))).otherwise(none)
        dummy = F.when(b.isin(*DUMMIES), F.array(issue("WARNING", "dummy_translation_block", s["line"], F.format_string("Translation '%s' near line %d", b, s["line"])))).otherwise(none)
        found = F.when((b == "") | apart, none).when(quote, orphan).otherwise(F.concat(dummy, of_lines(b, s["line"])))
        return F.struct(
            (s["line"] + n + 1).alias("line"),
            F.when(b == "", s["quote"]).when(apart, False).otherwise(quote).alias("quote"),
            F.when((b != "") & ~apart & quote, s["line"]).otherwise(s["at"]).alias("at"),
            F.concat(s["issues"], found).alias("issues"),
        )

    return F.when(T.text_of(x) == "", none).otherwise(F.aggregate(blocks, start, step, lambda s: s["issues"]))


def audit_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.inline(audit(text)))


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "type").agg(F.count("*").alias("issues"))
