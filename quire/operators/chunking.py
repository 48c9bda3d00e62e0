"""Token-budgeted chunks with the context before them.

A document's units come from a ladder of six splits, each of which only meets units over the budget: headings, blank lines, objections, inferences, sentences, clauses; what is still too long is cut by words.
Units are packed greedily. All of it is expressions over one row's arrays: no shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# The ladder's splits, in order, for classical Arabic.
ORDINALS = r"(?:الأول|الثاني|الثالث|الرابع|الخامس|السادس|السابع|الثامن|التاسع|العاشر|\d+|[٠-٩]+)"
HEADINGS = r"(?:المقصد|الباب|الفصل|المبحث|المسألة|المدخل|المقدمة|الخاتمة)"
OBJECTIONS = r"(?:فإن\s+قيل|إن\s+قلت|وقد\s+يقال|لا\s+يقال|لو\s+قيل|قلنا|فنقول|أجيب|والجواب|قلت|تنبيه|تذنيب|فائدة|إيقاظ|تبصرة|إضاءة)"
INFERENCES = (
    r"(?:وحيث\s+إن|ولما\s+كان|إذ\s+المفروض|بما\s+أن|المقدمة\s+الأولى|المقدمة\s+الثانية|فينتج|فيلزم|إذن|ومن\s+هنا|وحينئذ|"
    r"والحاصل|والمراد\s+به|والخلاصة|إذا\s+عرفت\s+هذا|ثم\s+إن|وعلى\s+هذا|هذا\s+و|أما\s+بعد)"
)


@dataclass(frozen=True)
class Profile:
    """Patterns of a kind of text."""

    splits: tuple[str, ...]
    heading: str
    #: for each split, a pattern (or "") without which it can't match: a search for it is far cheaper than the split
    needs: tuple[str, ...] = ()


ARABIC = Profile(
    splits=(
        rf"(?U)(?:^|\n)(?={HEADINGS}\s+{ORDINALS})",
        r"\n{2,}",
        rf"(?U)(?<=\s)(?={OBJECTIONS}[:\s])",
        rf"(?U)(?<=\s)(?={INFERENCES}\b)",
        r"(?U)(?<=[.؟!؛])\s+",
        r"(?U)(?<=[،,])\s+",
    ),
    heading=rf"{HEADINGS}(?:\s+{ORDINALS})?",
    needs=(f"[{T.ARABIC}]", "", f"[{T.ARABIC}]", f"[{T.ARABIC}]"),
)
LATIN = Profile(splits=(r"(?U)(?:^|\n)(?=(?:Chapter|Section|Part)\s+(?:\d+|[IVXL]+))", r"\n{2,}", r"(?U)(?<=\s)(?=(?:However|Objection|Reply)[,:\s])", r"(?U)(?<=\s)(?=(?:Therefore|Hence|Thus)\b)", r"(?U)(?<=[.?!;])\s+", r"(?U)(?<=,)\s+"), heading=r"(?:Chapter|Section|Part)(?:\s+(?:\d+|[IVXL]+))?")


def _parts(x: Column, pattern: str, need: str = "") -> Column:
    """A stripped text's parts."""
    parts = F.filter(F.transform(F.split(x, pattern), T.strip), lambda p: p != "")
    return F.when(x.rlike(need), parts).otherwise(F.array(x)) if need else parts


def not_blank(x: Column | str) -> Column:
    """Whether a text has units: what to ask before it is cut, as a condition on what it is cut into makes the optimizer cut it twice."""
    return T.strip(x) != ""


def least_chars(tokens: int) -> int:
    """The shortest text that counts so many tokens."""
    n = max(1, int(tokens * T.CHARS_PER_TOKEN) - 1)
    while max(1, int(n / T.CHARS_PER_TOKEN)) < tokens:
        n += 1
    return n


def _by_words(x: Column, max_tokens: int) -> Column:
    """Runs of words, each closed by the word that brings it to the budget: one pattern takes the characters that are short of it by one, and what is left of the word that follows."""
    least = least_chars(max_tokens)
    run = "[^ ]+" if least < 2 else rf"[^ ].{{{least - 2}}} ?[^ ]*|[^ ].*"
    return F.regexp_extract_all(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(f"(?s){run}"), F.lit(0))


def units(x: Column | str, max_tokens: int, profile: Profile = ARABIC) -> Column:
    """array<string>: a text's units, none over the budget but a single word or what the last cut leaves."""
    text = T.strip(x)
    out = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))

    def cut(all_: Column, how) -> Column:
        return F.flatten(F.transform(all_, lambda u: F.when(T.token_count(u) <= max_tokens, F.array(u)).otherwise(how(u))))

    for i, pattern in enumerate(profile.splits):
        out = cut(out, partial(_parts, pattern=pattern, need=profile.needs[i] if i < len(profile.needs) else ""))
    return cut(out, partial(_by_words, max_tokens=max_tokens))


def pack(units: Column, max_tokens: int) -> Column:
    """array<string>: units joined by a blank line while their own counts fit the budget."""
    # a fold over the counts finds where chunks begin; texts are cut once, at the end
    nothing = F.array().cast("array<int>")
    start = F.struct(nothing.alias("begins"), F.lit(0).alias("n"), F.lit(0).alias("at"))

    def step(state: Column, n: Column) -> Column:
        new = (state["n"] + n > max_tokens) | (state["at"] == 0)
        return F.struct(F.when(new, F.concat(state["begins"], F.array(state["at"]))).otherwise(state["begins"]).alias("begins"), F.when(new, n).otherwise(state["n"] + n).alias("n"), (state["at"] + 1).alias("at"))

    def cut(both: Column) -> Column:
        all_, begins = both["units"], both["begins"]
        end = lambda i: F.coalesce(F.get(begins, i + 1), F.size(all_))
        return F.transform(begins, lambda b, i: F.array_join(F.slice(all_, b + 1, end(i) - b), "\n\n"))

    def fold(all_: Column) -> Column:
        begins = F.aggregate(F.transform(all_, T.token_count), start, step, lambda s: s["begins"])
        return F.element_at(F.transform(F.array(F.struct(all_.alias("units"), begins.alias("begins"))), cut), 1)

    return F.element_at(F.transform(F.array(units), fold), 1)


def chunks(x: Column | str, max_tokens: int = 1500, overlap_tokens: int = 200, before: Column | None = None, profile: Profile = ARABIC) -> Column:
    """array<struct<index, text, token_count, prev_context>>. before: the end of an earlier part of the book."""
    packed = pack(units(x, max_tokens, profile), max_tokens)
    first = T.trailing_context(F.lit("") if before is None else before, overlap_tokens)

    def each(all_: Column) -> Column:
        return F.transform(
            all_,
            lambda c, i: F.struct(
                i.alias("index"),
                c.alias("text"),
                T.token_count(c).alias("token_count"),
                F.when(i == 0, first).otherwise(T.trailing_context(F.get(all_, i - 1), overlap_tokens)).alias("prev_context"),
            ),
        )

    return F.element_at(F.transform(F.array(packed), each), 1)  # packed once


def chunk_documents(docs: DataFrame, text: str = "text", max_tokens: int = 1500, overlap_tokens: int = 200, before: str | None = None, profile: Profile = ARABIC) -> DataFrame:
    """docs' other columns with chunk_index, chunk_text, token_count, prev_context, n_chunks; no row for a blank text."""
    keep = [c for c in docs.columns if c not in (text, before)]
    rows = docs.where(not_blank(text)).select(*keep, chunks(text, max_tokens, overlap_tokens, None if before is None else F.col(before), profile).alias("__chunks"))
    # outer, though each text has a chunk: for inline() the optimizer would ask for the chunks' number first, and cut each text twice
    return rows.select(*keep, F.size("__chunks").alias("n_chunks"), F.inline_outer("__chunks")).select(*keep, F.col("index").alias("chunk_index"), F.col("text").alias("chunk_text"), "token_count", "prev_context", "n_chunks")


def chunk_texts(docs: DataFrame, text: str = "text", max_tokens: int = 1500, profile: Profile = ARABIC) -> DataFrame:
    """Only the chunks' texts."""
    return chunk_documents(docs, text, max_tokens, 0, None, profile).drop("token_count", "prev_context", "n_chunks")


def source_hash(chunked: Column) -> Column:
    """SHA-256 of the texts of an array of chunks, one after another."""
    return F.sha2(F.array_join(F.transform(chunked, lambda c: c["text"]), "").cast("binary"), 256)
