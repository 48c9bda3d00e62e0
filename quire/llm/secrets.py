"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed (SHA-256). The ledger, Parquet in a folder, holds which (blob, rule, rule version) pairs were scanned and the findings. A scan takes the pairs that the ledger lacks,
reads each such blob once, wherever and however often it stands, adds its rows, and the findings are joined back to all paths. A rule whose version changes is scanned anew, the others are not.

Rules: base ones are leftmost and non-overlapping within a rule, and matches under the least length are dropped. The further rules add spans of their own. No pattern starts anew within a run that it has read
and none takes a run back, so a text is scanned in time linear in its length, however long its runs are.

Edge cases: null texts are empty blobs; very long texts are scanned whole, in a bounded number of passes; repeated rows and paths with equal texts all get the blob's findings; an empty table gives no rows and leaves the ledger unchanged;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common


@dataclass(frozen=True)
class Rule:
    """A rule; `least` characters in group `group`. `hint`: an RE2 pattern that any kept match holds, to pass over other texts quickly."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1
    base: bool = False


ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?"
#: In the order that equal starts are listed in.
RULES = (
    Rule("assign", 1, rf"{ASSIGN}([A-Za-z0-9+/_.=-]+)", rf"{ASSIGN}[A-Za-z0-9+/_.=-]{{6}}", 1, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 0, 20, True),
    Rule("hex", 1, r"[0-9a-f]+", r"[0-9a-f]{24}", 0, 24, True),
    Rule("upper_hex", 2, r"(?<![0-9A-F])(?:[0-9]++[A-F]|[A-F]++[0-9])[0-9A-F]*+", r"[0-9A-F]{32}", 0, 32),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("url_login", 2, r"(?<![a-z0-9+.-])[a-z0-9+.-]++://[^ \t-\r/:@]++:[^ \t-\r/@]{4,}+@", r"://[^ \t-\r/:@]+:[^ \t-\r/@]{4}"),
)


def spans_of(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Kept matches, in code points, end exclusive."""
    return [m.span() for m in re.compile(rule.pattern).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    """path, blob."""
    return versions.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("blob"))


SCANNED = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, version int, begin int, stop int"


class Ledger:
    """The ledger's two tables. Findings are written before their scan is told, so a scan that fails in between is made again; what a blob and a rule's version give is always the same, so its findings, then written twice, count once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED)

    def findings(self, rules: tuple[Rule, ...] | None = None) -> DataFrame:
        """Findings of the rules in their present versions."""
        out = self._read("findings", FINDINGS).dropDuplicates()
        return out if rules is None else out.where(F.struct("kind", "version").isin([F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules]) if rules else F.lit(False))

    def scan(self, versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is new; path, blob of all versions."""
        paths = common.shared_table(addressed(versions, path, text), "paths")
        wanted = [(r.kind, r.version) for r in rules]
        done = self.scanned().groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
        # a blob's first row stands for it; `need`: the rules, as bits, that the ledger lacks for it
        unseen = paths.groupBy("blob").agg(F.min("path").alias("first")).join(done, "blob", "left")
        bits = " | ".join(f"if(done is null or not array_contains(done, named_struct('kind', '{k}', 'version', {v})), {1 << i}, 0)" for i, (k, v) in enumerate(wanted)) or "0"
        unseen = common.shared_table(unseen.select("blob", "first", F.expr(bits).cast("int").alias("need")).where("need != 0"), "unseen")

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.text_slices(batches, "text"):
                texts, need = pc.fill_null(batch.column("text"), ""), batch.column("need").to_numpy()
                rows: list[tuple] = []
                for i, rule in enumerate(rules):
                    maybe = pc.match_substring_regex(texts, rule.hint).to_numpy(zero_copy_only=False) & (need >> i & 1).astype(bool)
                    for at in np.flatnonzero(maybe).tolist():
                        rows += [(at, rule.kind, rule.version, a, b) for a, b in spans_of(texts[at].as_py(), rule)]
                if rows:
                    at, kind, version, a, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("blob").take(pa.array(at)), pa.array(kind, pa.string()), pa.array(version, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["blob", "kind", "version", "begin", "stop"])

        texts = versions.select(F.col(path).alias("first"), F.col(text).alias("text"))
        texts = texts.join(unseen.select(F.col("first").alias("at"), "blob", "need"), F.col("first").eqNullSafe(F.col("at")))
        texts = texts.where(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) == F.col("blob"))  # a path may have several versions
        found = texts.select("blob", "need", "text").mapInArrow(find, FINDINGS)
        found.write.mode("append").parquet(f"{self.folder}/findings")
        each = F.array(*[F.when(F.col("need").bitwiseAND(F.lit(1 << i)) != 0, F.struct(F.lit(k).alias("kind"), F.lit(v).alias("version"))) for i, (k, v) in enumerate(wanted)])
        unseen.select("blob", F.inline(F.array_compact(each))).select("blob", "kind", F.col("version").cast("int").alias("version")).write.mode("append").parquet(f"{self.folder}/scanned")
        return paths


def per_path(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob, spans: array of (begin, number of the rule, kind, stop) in order, for every path; empty where nothing was found."""
    number = F.coalesce(*[F.when(F.col("kind") == r.kind, i) for i, r in enumerate(rules)])
    by_blob = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("begin", number.alias("number"), "kind", "stop"))).alias("spans"))
    empty = F.array().cast("array<struct<begin:int,number:int,kind:string,stop:int>>")
    return paths.join(by_blob, "blob", "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))


def digest(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans (text)."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["stop"])), ",")
    base = [r.kind for r in rules if r.base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in base]
    return rows.select(F.col("path").alias("doc_id"), *counts, F.sha2(text(of_base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
