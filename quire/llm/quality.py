"""Quality rules as a bitmask ledger, in built-in functions only.

Every rule is evaluated once: the ledger has a document's measurements and one bit for each rule that it fails. Policies are versioned masks over those bits;
applying one, or asking what a rule does within it, needs no text any more.

Edge cases: very long texts are measured whole (windows by sorted hashes, so in time n log n); null and empty texts have no words (all counts 0) and fail `few_words`; an empty table gives no rows; repeated rows are judged one by one;
other columns, whatever their names, are ignored (ledger) or passed through (keep).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  # SQL over the measurements


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 45 * n_lines"),
    Rule("short_words", 4, "word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 18 * n_words"),
    Rule("capitals", 6, "100 * n_capitals > 40 * word_chars"),
)
BASE = 0b11
#: (policy, version): the rules that reject.
POLICIES = {
    ("base", 1): BASE,
    ("default", 1): 0b0111111,
    ("default", 2): 0b1111111,
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def mask_of(*names: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in names)


def without(text: Column, letters: str) -> Column:
    for x in letters:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


#: Words in repeated 3-word windows. w: the words; h: a hash of each window; s: hashes led by their high bits and ended by the window's place, sorted, so that
#: equal windows stand side by side; what stands beside an equal is a repeated window, and each, in order of place, adds the words that the one before has not.
#: transform(array(x), v -> ...)[0] binds x once.
REPEATS = """
transform(array(words), w -> if(size(w) < 4, 0L,
  transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h -> if(size(array_distinct(h)) = size(h), 0L,
    transform(array(length(bin(size(h)))), k ->
      transform(array(sort_array(transform(h, (x, i) -> shiftleft(shiftright(x, k), k) | cast(i as bigint)))), s ->
        aggregate(
          sort_array(transform(
            filter(s, (x, i) ->
              (i > 0 and shiftright(x ^ s[greatest(i - 1, 0)], k) = 0 and h[cast(x & (shiftleft(1L, k) - 1) as int)] = h[cast(s[greatest(i - 1, 0)] & (shiftleft(1L, k) - 1) as int)])
              or (i < size(s) - 1 and shiftright(x ^ s[least(i + 1, size(s) - 1)], k) = 0 and h[cast(x & (shiftleft(1L, k) - 1) as int)] = h[cast(s[least(i + 1, size(s) - 1)] & (shiftleft(1L, k) - 1) as int)])),
            x -> x & (shiftleft(1L, k) - 1))),
          named_struct('n', 0L, 'at', -3L),
          (a, x) -> named_struct('n', a.n + least(3L, x - a.at), 'at', x),
          a -> a.n)
      )[0])[0]))[0]))[0]
"""


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the measurements of each document."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = texts.select(
        "doc_id",
        F.array_remove(F.split("text", r"[ \t-\r]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
        F.length(without(F.col("text"), SPACES)).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
    )
    return parts.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(REPEATS).alias("n_repeat_words"),
        "n_capitals",
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **columns: str) -> DataFrame:
    """doc_id, the measurements and `failed`, with a bit for each rule that fails."""
    bits = " | ".join(f"if({r.fails}, {1 << r.bit}L, 0L)" for r in rules)
    return measure(docs, **columns).withColumn("failed", F.expr(bits))


def apply_policy(rows: DataFrame, policy: str = "default", version: int = 2, policies: dict[tuple[str, int], int] = POLICIES) -> DataFrame:
    """The ledger with `kept`."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policies[policy, version])) == 0)


def ablation(rows: DataFrame, policies: dict[tuple[str, int], int] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents that fail the rule, that fail it alone (kept if it went), and that the policy rejects.

    The ledger is first counted by its bits, of which there are 2 ** rules at most, so the policies meet a few rows only."""
    counts = rows.groupBy("failed").agg(F.count("*").alias("docs"))
    wanted = [(p, v, r.name, m, 1 << r.bit) for (p, v), m in sorted(policies.items()) for r in rules if m >> r.bit & 1]
    each = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version"), F.lit(n).alias("rule"), F.lit(m).cast("bigint").alias("mask"), F.lit(b).cast("bigint").alias("bit")) for p, v, n, m, b in wanted])
    flat = counts.select("failed", "docs", F.inline(each))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    some = lambda c: F.sum(F.when(c, F.col("docs")).otherwise(0)).cast("bigint")
    return flat.groupBy("policy", "version", "rule").agg(some(hit.bitwiseAND(F.col("bit")) != 0).alias("fails"), some(hit == F.col("bit")).alias("fails_alone"), some(hit != 0).alias("rejected"))


def keep(docs: DataFrame, policy: str = "default", version: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, unchanged, that the policy keeps. No shuffle: the row itself rides along as the id."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kept = apply_policy(ledger(row), policy, version).where("kept")
    return kept.select("doc_id.*")
