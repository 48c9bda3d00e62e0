"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in built-in functions only.

Sources, by code point with null last, weigh 5, 2, 1, repeating, and share all words by weight; a target stops at `cap` times its source's words and the excess
is shared again by weight. A source's mix is its whole number of complete epochs, then a part of one more: documents in the order of exponential keys
-ln(u) / w (u: keyed and fixed for each document; w: its quality weight), up to the words that are left.

The order is never made of a whole source. Keys fall into `buckets` by 1 - exp(-key); word counts of the buckets, summed up, show which one holds the cut;
buckets before it are taken whole, later ones left, and only that bucket's documents are sorted.

Edge cases: a very long text counts with all its words, and goes in if the cut is past its middle; null and empty texts have size 0 and are never needed (taken 0); null ids have one fixed key; repeated rows count one by one; a source without words has
target 0; rows equal in id and key are decided together; an empty table gives no rows. Other columns are ignored (mix) or passed through (sample).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.quality import SYMBOLS, without

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKETS = 4096
#: Up to so many sources are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def words_of(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^ \t-\r]+")).cast("bigint")


def uniform(id_col: str, seed: int = 0) -> Column:
    """A number in (0, 1), fixed by the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target. sizes: source, size.

    The fill level follows from one pass in the order of cap / weight: sources before the level are at their caps, the rest get level * weight."""
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("bigint")
    of = of.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = of.select("*", F.sum("source_size").over(everything).alias("all_words"), F.coalesce(F.sum("most").over(before), F.lit(0)).alias("capped"), (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"))
    level = (F.col("all_words") - F.col("capped")) / F.col("open")
    # at the level that holds, the source that sets it isn't above its cap; of these the first is the least
    rows = rows.select("*", level.alias("level"), (level * F.col("weight") <= F.col("most")).alias("fits"))
    rows = rows.select("*", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("fill"))
    return rows.select("source", "source_size", F.when(F.col("fill") * F.col("weight") > F.col("most"), F.col("most").cast("double")).otherwise(F.coalesce(F.col("fill") * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def quality_weight(text_col: str = "text") -> Column:
    """1 for plain text, down to 0.1 as its symbols come up to its words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.greatest(F.lit(0.1), 1 - (F.length(text) - F.length(without(text, SYMBOLS))) / F.greatest(words_of(text_col), F.lit(1)))


def _decided_by(docs: DataFrame, quality: Column | None, id_col: str, text_col: str, source_col: str, seed: int, buckets: int) -> list[Column]:
    key = -F.log(uniform(id_col, seed)) / (quality_weight(text_col) if quality is None else quality)
    return [F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), words_of(text_col).alias("__size"), key.alias("__key")]


def _bucket(buckets: int) -> Column:
    return F.least(F.floor((1 - F.exp(-F.col("__key"))) * buckets), F.lit(buckets - 1)).cast("int")


def _cuts(rows: DataFrame, weights: tuple[int, ...], cap: int, buckets: int) -> DataFrame:
    """For each source: source_size, target, epochs and the key and id of the last document of the fraction."""
    rows = rows.withColumn("bucket", _bucket(buckets))
    # counts of the buckets: buckets * sources rows at most
    filled = common.shared_table(rows.groupBy(F.col("__source").alias("source"), "bucket").agg(F.sum("__size").alias("size")), "buckets")
    up_to = Window.partitionBy("source").orderBy("bucket")
    sums = filled.select(F.col("source").alias("s"), F.col("bucket").alias("cut_bucket"), "size", (F.sum("size").over(up_to) - F.col("size")).alias("before"))
    cut = source_targets(filled, weights, cap)
    cut = cut.select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("epochs"))
    cut = cut.select("*", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    inside = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))
    cut = cut.join(sums, F.col("s").eqNullSafe(F.col("source")) & inside, "left").select("source", "source_size", "target", "epochs", "rest", "cut_bucket", "before")
    cut = _sized(common.shared_table(cut, "cuts"))
    # within the bucket of the cut: a document goes in if the cut is past its middle
    near = rows.join(cut, F.col("__source").eqNullSafe(F.col("source")) & (F.col("bucket") == F.col("cut_bucket")))
    order = Window.partitionBy("source").orderBy("__key", F.coalesce("__id", F.lit(-1)), "__size").rowsBetween(Window.unboundedPreceding, 0)
    near = near.where("__size > 0").select("source", "__key", "__id", (F.col("before") + F.sum("__size").over(order) - F.col("__size") / 2 <= F.col("rest")).alias("goes"))
    last = near.where("goes").groupBy(F.col("source").alias("s")).agg(F.max(F.struct(F.col("__key").alias("key"), F.coalesce("__id", F.lit(-1)).alias("id"))).alias("last"))
    cut = cut.join(last, F.col("s").eqNullSafe(F.col("source")), "left")
    return _sized(common.shared_table(cut.select(F.col("source").alias("__cut"), "source_size", "target", "epochs", "cut_bucket", "last"), "fractions"))


def _sized(per_source: DataFrame) -> DataFrame:
    """Broadcast if there are few sources, as counted; joined by shuffle otherwise."""
    return F.broadcast(per_source) if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else per_source


def _with_copies(rows: DataFrame, cuts: DataFrame, buckets: int) -> DataFrame:
    rows = rows.withColumn("__bucket", _bucket(buckets)).join(cuts, F.col("__source").eqNullSafe(F.col("__cut")))
    here = F.struct(F.col("__key").alias("key"), F.coalesce("__id", F.lit(-1)).alias("id"))
    more = (F.col("__bucket") < F.col("cut_bucket")) | ((F.col("__bucket") == F.col("cut_bucket")) & (here <= F.col("last")))
    return rows.withColumn("copies", F.when(F.col("__size") > 0, F.col("epochs") + F.when(more, 1).otherwise(0)).otherwise(0).cast("bigint"))


def mix(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target (of its source), copies, taken (words, repeats counted). quality: a positive weight over docs' columns."""
    rows = common.shared_table(docs.select(_decided_by(docs, quality, id_col, text_col, source_col, seed, buckets)), "sizes")
    out = _with_copies(rows, _cuts(rows, weights, cap, buckets), buckets)
    return out.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("__size") * F.col("copies")).alias("taken"))


def sample(docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """The documents that the mix takes, each as many times as it is taken, all their columns unchanged. Texts are not shuffled."""
    decide = _decided_by(docs, quality, id_col, text_col, source_col, seed, buckets)
    cuts = _cuts(common.shared_table(docs.select(decide), "sizes"), weights, cap, buckets)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *decide)
    out = _with_copies(rows, cuts, buckets).where("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
