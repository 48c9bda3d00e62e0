"""What the operators of this package share: shared tables, whole-batch word splitting and hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
SPACE_REGEX = r"[\x20\x09-\x0D]+"
#: Text bytes that a Python step holds at once, beside one whole text.
SLICE_BYTES = 8 << 20
#: Up to so many document ids (8 bytes each), as counted, are broadcast to pick texts out.
BROADCAST_IDS = 1_000_000

_tables: list[tuple[SparkSession, str]] = []
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, the warehouse on a cluster, a temporary folder in local mode."""
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    _local_dir = _local_dir or tempfile.mkdtemp(prefix="quire-")
    return f"file://{_local_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder, deleted by drop_tables() or when the process ends."""
    path = f"{shared_dir(spark)}/quire/{uuid.uuid4().hex}/{name}"
    _tables.append((spark, path))
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: it cuts lineage and survives a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.quire_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(os.path.dirname(path.removeprefix("file://")), ignore_errors=True)


def drop_table(*tables: DataFrame) -> None:
    """Delete shared tables whose last reader has been written."""
    drop_paths([t.quire_path for t in tables])


def drop_paths(paths: list[str]) -> None:
    """Delete folders of new_path(). The driver's collector then lets go of their writers' shuffles, whose files executors would keep until it runs by itself."""
    gone = [t for t in _tables if t[1] in paths]
    for t in gone:
        _tables.remove(t)
        delete(*t)
    if gone:
        collect(gone[-1][0])


def collect(spark: SparkSession) -> None:
    """Let executors delete the shuffles that nothing holds any more: Python's cycles are let go of first, as they may hold the JVM's objects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def noting():
    """A list that holds, at the end, the folders of new_path() that were made within and are still there."""
    before, made = {p for _, p in _tables}, []
    yield made
    made += [p for _, p in _tables if p not in before]


def drop_tables(keep: int = 0) -> None:
    """Delete the shared tables written so far, but the first keep."""
    while len(_tables) > keep:
        delete(*_tables.pop())


@atexit.register
def _clean() -> None:
    drop_tables()
    if _local_dir:
        import shutil

        shutil.rmtree(_local_dir, ignore_errors=True)


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def trim() -> None:
    """Give free memory back to the system: a Python worker lives on, idle, beside the next steps of its executor."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


#: What a worker keeps from one task for the next of the same kind of step, by kind.
_kept: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """A worker's memory of a kind of step, which is empty again once a step of another kind has run."""
    return _kept.setdefault(kind, {})


def text_slices(batches, column: str, max_bytes: int = SLICE_BYTES, max_rows: int = 8192, keeps: str = ""):
    """Parts of Arrow batches of at most so many text bytes, or one row; what a part took is given back when the next is asked for. keeps: the kind of step, if it keeps something."""
    for kind, things in _kept.items():
        if kind != keeps:
            things.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // max_bytes
        at = 0
        for cut in [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]:
            while at < cut:
                n = min(cut - at, max_rows)
                yield batch.slice(at, n)
                trim()
                at += n


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of whole texts (null: none), and where each text's words begin, with the end."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py() if len(words) else False:
        keep = full.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        words = words.filter(full)
    return words, ends


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    distinct = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return distinct[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def window_hashes(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash for each run of k words: len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    by = odd_numbers(k, seed)
    total = words[:n] * by[0]
    for j in range(1, k):
        total = total + words[j : j + n] * by[j]
    return mix(total)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def few(ids: DataFrame, most: int) -> DataFrame:
    """ids, written as a shared table; marked for broadcast if a count finds at most so many rows, joined by shuffle otherwise."""
    ids = shared_table(ids, "ids")
    return F.broadcast(ids) if ids.count() <= most else ids
