"""URL filters: rules, then logistic regression on hashed character n-grams of host and path, in built-in functions only.

Training: the labelled URLs (the `max_labelled` first by hash, a documented bound of the sample) become arrays of hashed n-gram numbers in one partition; each step of gradient descent is one
aggregation over them without a shuffle, and its result is a gradient of at most 2 ** `bits` numbers, which is all that the driver sees. Steps have momentum and end when no weight moves by `TOLERANCE` any more.
Scoring adds up the weights, a literal of that size, at a URL's n-grams.

Parts of a url. Host: after the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case. Path: from there up to `?`, `#` or the end.
Edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and is judged by the model's bias; an empty table gives no rows; repeated rows are judged
one by one, very long urls whole; other columns, whatever their names, are ignored. Without labelled URLs of both kinds the model allows everything (or blocks, if all are blocked).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, url_table

ALLOW, BLOCK = "allow", "block"
#: N-gram lengths, hashed features (2 ** BITS), steps, step size, penalty, most labelled URLs used.
NGRAMS = (3, 4)
BITS = 12
STEPS = 40
RATE = 40.0
MOMENTUM = 0.8
PENALTY = 1e-4
#: The largest move of a weight at which training ends.
TOLERANCE = 0.02
MAX_LABELLED = 20_000

#: Rules of the query: (host and path, verdict).
RULES = (("com/en/", BLOCK), ("example.com/en/7", ALLOW), ("net/de/", ALLOW), ("example.net/de/8", BLOCK), ("org/es/", BLOCK))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, blocked (0 or 1): the built-in labelled table."""
    rows = [(url, blocked) for blocked, urls in ((0, url_table.ALLOWED), (1, url_table.BLOCKED)) for url in urls]
    return spark.createDataFrame(rows, "url string, blocked int")


def host(url: str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: str, path: str, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, null if none. A rule fits its host and all subdomains, if the path starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        name = name.lower()
        fits = ((F.col(host) == name) | F.endswith(F.col(host), F.lit(f".{name}"))) & F.startswith(F.col(path), F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def features(host: str, path: str, bits: int = BITS, ngrams: tuple[int, ...] = NGRAMS) -> Column:
    """Numbers of the distinct hashed n-grams: of the host in < >, and of the path."""

    def grams(text: Column, side: int, n: int) -> Column:
        # letters as an array, so that a very long url is read in time linear in its length
        number = lambda t, i: F.pmod(F.xxhash64(F.lit(side), *[F.get(t, i + j) for j in range(n)]), F.lit(1 << bits)).cast("int")
        each = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: number(t, i))).otherwise(F.array().cast("array<int>"))
        return F.element_at(F.transform(F.array(F.split(text, "")), each), 1)

    sides = (F.concat(F.lit("<"), F.col(host), F.lit(">")), F.col(path))
    return F.array_distinct(F.concat(*[grams(text, side, n) for side, text in enumerate(sides) for n in ngrams]))


@dataclass(frozen=True)
class Model:
    """weights[2 ** bits] is the bias. A URL's features are divided by the root of their number."""

    weights: tuple[float, ...]
    bits: int = BITS
    ngrams: tuple[int, ...] = NGRAMS

    def margin(self, found: Column) -> Column:
        return margin(found, literal(self.weights), self.bits)

    def probability(self, host: str, path: str) -> Column:
        """Of being blocked."""
        return 1 / (1 + F.exp(-self.margin(features(host, path, self.bits, self.ngrams))))


def literal(weights) -> Column:
    """The weights as one constant."""
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def margin(found: Column, weights: Column, bits: int) -> Column:
    """Bias + sum of the features' weights / sqrt(their number)."""
    bind = F.transform(F.array(weights), lambda w: w[1 << bits] + F.aggregate(found, F.lit(0.0), lambda a, i: a + w[i]) / F.sqrt(F.greatest(F.size(found), F.lit(1))))
    return F.element_at(bind, 1)


def train(labelled: DataFrame, bits: int = BITS, ngrams: tuple[int, ...] = NGRAMS, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY, max_labelled: int = MAX_LABELLED) -> Model:
    """labelled: url, blocked (0 or 1; rows with null are left out)."""
    rows = labelled.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(max_labelled).select("y", host("url").alias("h"), path("url").alias("p"))
    rows = common.shared_table(rows.select("y", features("h", "p", bits, ngrams).alias("f")).coalesce(1), "labelled").coalesce(1)
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    weights, moves = [0.0] * ((1 << bits) + 1), [0.0] * ((1 << bits) + 1)
    if not n or ones in (0, n):
        weights[-1] = 5.0 if n and ones == n else -5.0
        return Model(tuple(weights), bits, ngrams)
    for _ in range(steps):
        wrong = rows.select("f", (F.col("y") - 1 / (1 + F.exp(-margin(F.col("f"), literal(weights), bits)))).alias("e"))
        each = F.transform("f", lambda i: F.struct(i.alias("i"), (F.col("e") / F.sqrt(F.size("f"))).alias("g")))
        got = wrong.select(F.inline(F.concat(each, F.array(F.struct(F.lit(1 << bits).alias("i"), F.col("e").alias("g")))))).groupBy("i").agg((F.sum("g") / n).alias("g"))
        gradient = {i: g for i, g in got.collect()}  # at most 2 ** bits + 1 rows
        moves = [MOMENTUM * m + (1 - MOMENTUM) * rate * (gradient.get(i, 0.0) - penalty * w) for i, (m, w) in enumerate(zip(moves, weights, strict=True))]
        weights = [w + m for w, m in zip(weights, moves, strict=True)]
        if max(map(abs, moves)) < TOLERANCE:
            break
    return Model(tuple(weights), bits, ngrams)


def judge(pages: DataFrame, model: Model, rules: tuple[tuple[str, str], ...] = (), url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, host, path, rule, verdict and `blocked_probability` (the model's) for every row. Map-side only."""
    parts = pages.select(*keep, host(url).alias("host"), path(url).alias("path"))
    told = parts.select("*", rule_for("host", "path", rules).alias("rule"), model.probability("host", "path").alias("blocked_probability"))
    verdict = F.when(F.col("blocked_probability") >= 0.5, BLOCK).otherwise(ALLOW)
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, says).otherwise(verdict)
    return told.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "blocked_probability")
