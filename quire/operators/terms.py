"""Glossaries and the terms that a session has learned: keyed tables with an explicit order (`seq`).

glossary: lang, domain, category, arabic, target, seq. terms: arabic, target, source_chunk (-1 static, 0 preloaded, above: the chunk), seq, and `overwrite`.
record() and flatten_glossary() also take rows with a text's terms in an array, `terms`: array<struct<arabic, target, seq>>, as a row of Spark's for each word of a corpus takes longer than what is done with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, IntegralType

from quire.functions import normalize as N
from quire.functions import text as T

# Honorifics that are no terms.
HONORIFICS = ("صلى الله عليه وآله", "صلى الله عليه وآله وسلم", "عليه السلام", "عليهم السلام", "سلام الله عليه", "رضي الله عنه", "قدس سره", "رحمه الله", "عز وجل", "سبحانه وتعالى")
MAX_SOURCE_WORDS, MAX_TARGET_WORDS = 6, 8
# A line that pairs two terms; the section of new terms; terms in brackets and parentheses.
PAIR_LINE = r"^\s*[-*•]?\s*([^\n\r:=→\-]+?)\s*[:=→\-]\s*([^\n\r]+)$"
NEW_TERMS = r"###\s*NOVEL\s+TERMS:\s*"
BRACKET = r"\[(?:i\.e\.,?\s*)?([^\]:\n\r]+)[:=]([^\]\n\r]+)\]"
PAREN = r"([A-Za-z\s'-]{3,60})\s*\(([؀-ۿ\s]{3,40})\)"
PAREN_BACK = r"([؀-ۿ\s]{3,40})\s*\(([A-Za-z\s'-]{3,60})\)"
PAREN_LATIN = PAREN.replace("A-Za-z", r"\p{IsLatin}")
PAREN_BACK_LATIN = PAREN_BACK.replace("A-Za-z", r"\p{IsLatin}")


def words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))


#: Rows that ends() looks at together; of what is left of them so many are held for another look, and handed on if it does not make them half as many.
LOOK = 1 << 20


def _ends_of(rows: pa.Table, keys: tuple[str, ...], last: bool) -> pa.Table:
    """Rows whose seq is the least (or, if asked for, the greatest) of their keys, ties and nulls included, and overwriting ones."""
    code, n = np.zeros(rows.num_rows, np.int64), 1
    for k in keys:
        each = rows[k].combine_chunks().dictionary_encode(null_encoding="encode")
        each = each.combine_chunks() if isinstance(each, pa.ChunkedArray) else each
        code = code * len(each.dictionary) + each.indices.to_numpy(zero_copy_only=False)
        n *= max(1, len(each.dictionary))
        if n > 8 * LOOK:  # keys that don't all occur together
            found, code = np.unique(code, return_inverse=True)
            n = len(found)
    seq = rows["seq"].combine_chunks()
    null, seq = seq.is_null().to_numpy(zero_copy_only=False), seq.fill_null(0).to_numpy(zero_copy_only=False)
    told = np.flatnonzero(~null)
    told = told if np.all(seq[told][1:] >= seq[told][:-1]) else told[np.argsort(seq[told], kind="stable")]
    end = np.zeros(n, seq.dtype)
    keep = null
    for order in (told[::-1], told) if last else (told[::-1],):
        end[code[order]] = seq[order]  # of a code's values the last stays
        keep = keep | (seq == end[code])
    if "overwrite" in rows.column_names:
        keep = keep | rows["overwrite"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
    return rows.filter(pa.array(keep))


def _flat(batch: pa.RecordBatch) -> pa.Table:
    """A row for each of `terms`, null ones left out."""
    if "terms" not in batch.schema.names:
        return pa.Table.from_batches([batch])
    lists = batch.column("terms")
    parents, each = pc.list_parent_indices(lists), pc.list_flatten(lists)
    own = {k: batch.column(k).take(parents) for k in batch.schema.names if k != "terms"}
    return pa.table(own | {f.name: part for f, part in zip(each.type, each.flatten(), strict=True)}).filter(each.is_valid())


def ends(rows: DataFrame, keys: tuple[str, ...], last: bool = False) -> DataFrame:
    """rows (flat, if in arrays) without those that are not the first of their keys by seq (or the last, if asked for) among rows that a task meets one after another: what is left has the same first and last rows.

    Spark aggregates texts by sorting all rows; this passes each row once, so that few are left to be sorted. All rows are left if seq is not a whole number."""
    flat = rows.select(*[c for c in rows.columns if c != "terms"], F.inline("terms")) if "terms" in rows.columns else rows
    kinds = {f.name: f.dataType for f in flat.schema}
    if not isinstance(kinds["seq"], IntegralType) or not all(isinstance(kinds[k], AtomicType) for k in keys):
        return flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, held, n, m = [], [], 0, 0
        step = 512 if "terms" in rows_columns else LOOK
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            new.append(_flat(batch))
            n += new[-1].num_rows
            if n >= LOOK:
                left = _ends_of(pa.concat_tables(new), keys, last)
                held.append(left)
                m += left.num_rows
                new, n = [], 0
                if m >= LOOK:
                    left = _ends_of(pa.concat_tables(held), keys, last)
                    if left.num_rows > LOOK // 2:
                        yield from left.to_batches()
                    held, m = ([], 0) if left.num_rows > LOOK // 2 else ([left], left.num_rows)
        if new:
            held.append(_ends_of(pa.concat_tables(new), keys, last))
        if held:
            yield from _ends_of(pa.concat_tables(held), keys, last).to_batches()

    rows_columns = rows.columns
    return rows.mapInArrow(run, flat.schema)


def flatten_glossary(glossary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """arabic, target, seq (of the first), the last target of each term."""
    given = ["terms"] if "terms" in glossary.columns else ["arabic", "target", "seq"]
    rows = ends(glossary.select(*by, *given), (*by, "arabic"), last=True)
    return rows.groupBy("arabic", *by).agg(F.max_by("target", "seq").alias("target"), F.min("seq").alias("seq")).select(*by, "arabic", "target", "seq")


def prompt_glossary(glossary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`block`: a heading for each category in order, and a line for each term."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "arabic", "target"))), lambda t: F.concat(F.lit("- "), t["arabic"], F.lit(" → "), t["target"]))
    each = glossary.groupBy(*by, "category").agg(F.min("seq").alias("seq"), F.array_join(lines, "\n").alias("lines"))
    heading = F.concat(F.lit("\n### "), F.initcap(F.translate("category", "_", " ")), F.lit("\n"), F.col("lines"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("seq", heading.alias("text")))), lambda b: b["text"])
    return each.groupBy(*by).agg(F.array_join(blocks, "\n").alias("block"))


def resolve_glossary(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests: path, lang, domain. files: lang, domain, path (lang null: the old single file). Adds `resolved` and `level`: 0 the explicit path, 1 language and domain, 2 the domain in English,
    3 the language's first file by name, 4 the old file. An equal join for each level."""
    files = files.select(F.lower("lang").alias("__lang"), F.lower("domain").alias("__domain"), F.col("path").alias("__path"))
    rows = requests.withColumns({"__l": F.lower(T.strip("lang")), "__d": F.lower(T.strip("domain")), "__en": F.lit("en"), "__one": F.lit(1)})

    def level(rows: DataFrame, name: str, files: DataFrame, keys: dict[str, str]) -> DataFrame:
        first = files.groupBy(*keys.values()).agg(F.min("__path").alias(name))
        return rows.join(first, [rows[a].eqNullSafe(first[b]) for a, b in keys.items()], "left").drop(*keys.values())

    told = files.where("__lang is not null")
    out = level(rows, "__1", told, {"__l": "__lang", "__d": "__domain"})
    out = level(out, "__2", told, {"__en": "__lang", "__d": "__domain"})
    out = level(out, "__3", told, {"__l": "__lang"})
    out = level(out, "__4", files.where("__lang is null").withColumn("__old", F.lit(1)), {"__one": "__old"})
    path = F.nullif(F.col("path"), F.lit(""))
    which = [path, *map(F.col, ("__1", "__2", "__3", "__4"))]
    return out.select(*requests.columns, F.coalesce(*which).alias("resolved"), F.coalesce(*[F.when(c.isNotNull(), i) for i, c in enumerate(which)]).alias("level"))


def available_glossaries(files: DataFrame) -> DataFrame:
    """lang, domains (sorted)."""
    return files.where("lang is not null").groupBy("lang").agg(F.sort_array(F.collect_set("domain")).alias("domains"))


def few(x: Column, most: int) -> Column:
    # a term of one word, as most are, needs no split
    return ~x.rlike(r"(?U)\s") | (words(x) <= most)


def bare_target(x: Column) -> Column:
    return F.when(F.substring(T.strip(x), -1, 1).isin(";", ",", "."), F.regexp_replace(T.strip(x), r"[;,.]+\z", "")).otherwise(T.strip(x))


def has_target(x: Column) -> Column:
    """Whether accepted() takes the target. Most begin with a letter and are too short for more words, which is told without a pattern."""
    short = (F.length(x) <= 2 * MAX_TARGET_WORDS) & ~F.substring(x, 1, 1).isin("", ";", ",", ".", *T.WHITE)
    # in a lambda, as the code for it would make the loop over rows longer than what the JVM compiles
    return short | F.exists(F.array(x), lambda t: (bare_target(t) != "") & few(bare_target(t), MAX_TARGET_WORDS))


def accepted(terms: DataFrame, normalize: bool = True) -> DataFrame:
    """Terms with their key in `arabic` and a trimmed target, without honorifics, sentences and blanks."""
    key = N.term_key("arabic") if normalize else T.strip(F.regexp_replace("arabic", r"(?U)\s+", " "))
    target = bare_target(F.col("target"))
    honorific = F.exists(F.array(*map(F.lit, HONORIFICS)), lambda h: F.contains("arabic", h))
    rows = terms.withColumns({"arabic": key, "target": target})
    return rows.where((F.col("arabic") != "") & (F.col("target") != "") & few(F.col("arabic"), MAX_SOURCE_WORDS) & few(F.col("target"), MAX_TARGET_WORDS) & ~(has_arabic(F.col("arabic")) & honorific))


def record(terms: DataFrame, known: DataFrame | None = None, by: tuple[str, ...] = (), normalize: bool = True) -> DataFrame:
    """The memory after all terms, in order of seq: by, arabic, target, source_chunk, seq, is_new.

    The first of a key stays, unless a later one overwrites it; an overwriting term keeps the key's place. known: the memory before.
    All of it is partial aggregation: a key's first term and its last overwriting one, so a word that stands everywhere is one row from each task.
    What accepted() tells of a term's key is told of the rows that are left, as it is the same for equal words."""
    some = terms.withColumn("terms", F.filter("terms", lambda t: has_target(t["target"]))) if "terms" in terms.columns else terms.where(has_target(F.col("target")))
    rows = accepted(ends(some, (*by, "arabic")), normalize)
    if "overwrite" not in rows.columns:
        rows = rows.withColumn("overwrite", F.lit(None).cast("boolean"))
    rows = rows.select(*by, "arabic", "target", "source_chunk", "seq", "overwrite", F.lit(1).alias("__new"))
    if known is not None:
        rows = known.select(*by, "arabic", "target", "source_chunk", "seq", F.lit(None).cast("boolean").alias("overwrite"), F.lit(0).alias("__new")).unionByName(rows)
    term = F.struct("__new", "seq", "target", "source_chunk")  # old before new, then in order
    first, over = F.min(term).alias("__first"), F.max(F.when(F.col("overwrite"), term)).alias("__over")
    out = rows.groupBy("arabic", *by).agg(first, over)  # sorted by words first, which differ sooner
    last = F.coalesce("__over", "__first")
    return out.select(*by, "arabic", last["target"].alias("target"), last["source_chunk"].alias("source_chunk"), F.col("__first.seq").alias("seq"), (F.col("__first.__new") == 1).alias("is_new"))


def recorded(before: DataFrame, terms: DataFrame, by: tuple[str, ...] = (), normalize: bool = True) -> DataFrame:
    """Numbers of terms added, by `by`."""
    return record(terms, before, by, normalize).groupBy(*by).agg(F.count_if("is_new").alias("added"))


def lookup(rows: DataFrame, memory: DataFrame, term: str, by: tuple[str, ...] = (), normalize: bool = True) -> DataFrame:
    """rows with `target` (null if unknown) and `known`."""
    key = N.term_key(term) if normalize else T.strip(F.regexp_replace(term, r"(?U)\s+", " "))
    m = memory.select(*by, F.col("arabic").alias("__key"), "target")
    out = rows.withColumn("__key", key).join(m, [*by, "__key"], "left")
    return out.select(*rows.columns, "target", F.col("target").isNotNull().alias("known"))


def novel(memory: DataFrame, include_static: bool = False) -> DataFrame:
    return memory if include_static else memory.where("source_chunk >= 0")


def has_novel(memory: DataFrame, by: tuple[str, ...] = (), include_static: bool = False) -> DataFrame:
    return memory.groupBy(*by).agg(F.bool_or((F.col("source_chunk") >= 0) | F.lit(include_static)).alias("has_novel"))


def last_terms(memory: DataFrame, max_terms: int = 40, by: tuple[str, ...] = (), include_static: bool = False) -> DataFrame:
    """The last terms by order, with `n` from 1."""
    rows = novel(memory, include_static)
    if not by:
        rows = rows.orderBy(F.desc("seq")).limit(max_terms)
        return rows.withColumn("n", F.row_number().over(Window.orderBy("seq")))
    back = rows.withColumn("__back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("seq")))).where(F.col("__back") <= max_terms)
    return back.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).drop("__back")


def prompt_terms(memory: DataFrame, max_terms: int = 40, by: tuple[str, ...] = (), include_static: bool = False) -> DataFrame:
    """`block`: a heading and a line for each of the last terms."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "arabic", "target"))), lambda t: F.concat(F.lit("- "), t["arabic"], F.lit(": "), t["target"]))
    rows = last_terms(memory, max_terms, by, include_static).groupBy(*by).agg(F.array_join(lines, "\n").alias("lines"))
    return rows.where("lines != ''").select(*by, F.concat(F.lit("[Terms settled earlier in this book]:\nKeep to these renderings:\n"), F.col("lines")).alias("block"))


def has_arabic(x: Column) -> Column:
    return x.rlike(f"[{T.ARABIC}]")


def oriented(left: Column, right: Column) -> Column:
    """struct<arabic, target>, or null unless just one side is Arabic."""
    pair = lambda a, b: F.struct(a.alias("arabic"), b.alias("target"))
    return F.when(has_arabic(left) & ~has_arabic(right), pair(left, right)).when(has_arabic(right) & ~has_arabic(left), pair(right, left))


def _pairs(text: Column, pattern: str, build) -> Column:
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
    return F.filter(F.transform(both, lambda p: build(p["a"], p["b"])), lambda p: p.isNotNull())


def audit_terms(x: Column | str, skip_none: bool = False) -> Column:
    """array<struct<arabic, target>> of an audit: its section of new terms, or all of it. The last of equal sources counts, at the place of the first."""
    text = T.text_of(x)
    section = F.regexp_extract(text, rf"(?iU){NEW_TERMS}((?s:.*?))(?=###|\z)", 1)
    content = F.when(text.rlike(f"(?iU){NEW_TERMS}"), T.strip(section)).otherwise(text)
    return pair_lines(content, skip_none)


def pair_lines(content: Column, skip_none: bool = False) -> Column:
    def build(a: Column, b: Column) -> Column:
        out = oriented(T.strip(a), T.strip(b))
        return F.when(~F.lower(T.strip(a)).isin("none", "n/a", "no novel terms"), out) if skip_none else out

    found = _pairs(content, rf"(?mU){PAIR_LINE}", build)
    return last_wins(found)


def last_wins(pairs: Column) -> Column:
    """Pairs once for each source, at its first place, with its last target."""

    def each(all_: Column) -> Column:
        sources = F.array_distinct(F.transform(all_, lambda p: p["arabic"]))
        return F.transform(sources, lambda s: F.element_at(F.filter(all_, lambda p: p["arabic"] == s), -1))

    return F.element_at(F.transform(F.array(pairs), each), 1)


def text_terms(x: Column | str, latin_letters: bool = False) -> Column:
    """array<struct<form, arabic, target>> that a text explains: in brackets, as `target (source)` and as `source (target)`, in that order.
    Latin phrases are of ASCII letters; latin_letters takes all of the script."""
    text = T.text_of(x)
    tag = lambda form, p: F.transform(p, lambda t: F.struct(F.lit(form).alias("form"), t["arabic"].alias("arabic"), t["target"].alias("target")))
    bracket = _pairs(text, rf"(?iU){BRACKET}", lambda a, b: oriented(T.strip(a), T.strip(b)))
    some = lambda ar, tr: F.when(T.clean_target(tr) != "", F.struct(T.strip(ar).alias("arabic"), T.clean_target(tr).alias("target")))
    paren = _pairs(text, rf"(?U){PAREN_LATIN if latin_letters else PAREN}", lambda a, b: some(b, a))
    back = _pairs(text, rf"(?U){PAREN_BACK_LATIN if latin_letters else PAREN_BACK}", lambda a, b: some(a, b))
    return F.concat(tag("bracket", bracket), tag("paren", paren), tag("paren_back", back))


def extract_terms(rows: DataFrame, text: str = "text", by: tuple[str, ...] = (), latin_letters: bool = False) -> DataFrame:
    """Terms of texts, ready for record(): by, arabic, target, source_chunk 0, seq (rows' `seq`, then the place in the text), form."""
    flat = rows.select(*by, "seq", F.posexplode(text_terms(text, latin_letters)).alias("pos", "t"))
    return flat.select(*by, F.col("t.arabic").alias("arabic"), F.col("t.target").alias("target"), F.lit(0).alias("source_chunk"), F.struct("seq", "pos").alias("seq"), F.col("t.form").alias("form"))
