"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of a window's words and ignore the others, so a window with substituted words still hashes alike under the masks that ignore them.
Seeds of the benchmark (a stated set, in blocks of a bounded size) go to every task; a document's seeds are looked up in a bitmap, then exactly. Around each hit the item is
laid on the document at the hit's offset, without gaps, and of its runs with at least `min_identity` equal words the one with the most of them is taken, from its first equal word to its last.

Words: runs of letters, digits and marks, in lower case. A pair is reported if the run's equal words are at least `min_words` (or 0.7 of a shorter item).

Edge cases: null and empty texts hold no words; very long texts are searched whole, in slices of their own; items without words match nothing; items shorter than the masks are sought as whole word runs; repeated rows are reported
one by one; an empty table on either side gives no rows; other columns are ignored (find) or passed through (clean).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common

#: 1: the word counts; 0: it may be any. Any one substitution inside a window is ignored by one of them; one at its ends leaves the next windows.
MASKS = ("11101011", "11011101", "10110111")
MIN_WORDS = 13
MIN_IDENTITY = 0.75
#: Benchmark words held by a task at once.
BLOCK_WORDS = 2_000_000
BITS = 22
#: Text bytes that a step holds at once, beside one whole text.
SLICE_BYTES = common.SLICE_BYTES // 4
SCHEMA = "doc_id bigint, item_id bigint, doc_start int, doc_end int, item_start int, item_end int, n_equal int, n_words int"


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and where each text's begin."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN\pM]+", " ")
    words, ends = common.split_words(plain, lower=False)
    return common.hash_strings(words), ends


def seeds(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The mask's hash at each place; the last len(mask) - 1 places have none."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    by, total = common.odd_numbers(len(mask), 100 + number), np.zeros(n, np.uint64)
    for j, on in enumerate(mask):
        if on == "1":
            total += words[j : j + n] * by[j]
    return common.mix(total)


def best_run(equal: np.ndarray, min_identity: float) -> tuple[int, int]:
    """Of the runs with at least min_identity equal words the one with the most, without others at its ends; the shortest of several."""
    count = np.concatenate([[0], np.cumsum(equal)])
    if not count[-1]:
        return 0, 0
    ahead = count - min_identity * np.arange(len(count))
    low = np.minimum.accumulate(ahead)
    start = np.searchsorted(-low, -ahead - 1e-9)  # the first place from which the run to each end has min_identity
    n = count - count[start]
    ends = np.flatnonzero(n == n.max())
    at = np.flatnonzero(equal)
    first, last = at[count[start[ends]]], at[count[ends] - 1] + 1
    k = int(np.argmin(last - first))
    return int(first[k]), int(last[k])


class Block:
    """Part of the benchmark, ready to be looked up."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, ends: np.ndarray, masks: tuple[str, ...]):
        self.ids, self.words, self.ends, self.masks, self.short = ids, words, ends, masks, []
        width = max(map(len, masks))
        keys, items, places = [], [], []
        for number, mask in enumerate(masks):
            for item, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                found = seeds(words[a:b], mask, number)
                keys.append(found)
                items.append(np.full(len(found), item))
                places.append(np.arange(len(found)))
        for item, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if 0 < b - a < width:
                self.short.append((item, words[a:b]))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], np.concatenate(items)[order] if keys else key, np.concatenate(places)[order] if keys else key
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.key >> np.uint64(64 - BITS)] = True

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Rows of item, offset (of the item's first word in the texts), each pair once."""
        out = []
        for number, mask in enumerate(self.masks):
            found = seeds(words, mask, number)
            at = np.flatnonzero(self.bitmap[found >> np.uint64(64 - BITS)])
            key = found[at]
            low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append(np.stack([self.item[entry], np.repeat(at, n) - self.place[entry]], axis=1).astype(np.int64))
        for item, run in self.short:
            if len(words) >= len(run):
                at = np.flatnonzero(words[: len(words) - len(run) + 1] == run[0])
                for j in range(1, len(run)):
                    at = at[words[at + j] == run[j]]
                out.append(np.stack([np.full(len(at), item), at], axis=1).astype(np.int64))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


_ready: dict[str, Block] = common.kept("block")


def ready(name: str, make) -> Block:
    """The block of this name, made once by a worker, which keeps the last one only."""
    if name not in _ready:
        _ready.clear()
        _ready[name] = make()
    return _ready[name]


def matches(block: Block, words: np.ndarray, ends: np.ndarray, min_words: int, min_identity: float) -> list[tuple]:
    """(text, item, doc_start, doc_end, item_start, item_end, n_equal, n_words); of overlapping runs of one item in one text, the best."""
    best: dict[tuple[int, int], list[tuple]] = {}
    for item, offset in block.hits(words).tolist():
        a, b = block.ends[item], block.ends[item + 1]
        size = int(b - a)
        lo, hi = max(0, -offset), min(size, len(words) - offset)
        equal = words[offset + lo : offset + hi] == block.words[a + lo : a + hi]
        # the overlap may span texts: seen one by one
        first = int(np.searchsorted(ends, offset + lo, "right")) - 1
        while first < len(ends) - 1 and ends[first] < offset + hi:
            x, y = max(int(ends[first]) - offset, lo), min(int(ends[first + 1]) - offset, hi)
            if y > x:
                s, e = best_run(equal[x - lo : y - lo], min_identity)
                n = int(equal[x - lo : y - lo][s:e].sum())
                if n >= min(min_words, 0.7 * size) and n:
                    start = offset + x + s - int(ends[first])
                    best.setdefault((first, item), []).append((n, start, start + e - s, x + s, x + e))
            first += 1
    out = []
    for (text, item), runs in best.items():
        taken: list[tuple] = []
        for n, s, e, i, j in sorted(runs, key=lambda r: (-r[0], r[1:])):
            if all(e <= s2 or s >= e2 for _, s2, e2, _, _ in taken):
                taken.append((n, s, e, i, j))
        out += [(text, item, s, e, i, j, n, e - s) for n, s, e, i, j in taken]
    return sorted(out)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The benchmark's words, so many at a time, streamed through the driver one partition at a time."""
    ids, words, ends, have = [], [], [0], 0
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("i is not null").orderBy("i", "t")
    lot: list = []

    def add(lot):
        nonlocal have
        got, cuts = normal_words(pa.array([t for _, t in lot], pa.string()))
        ids.extend(i for i, _ in lot)
        words.append(got)
        ends.extend((cuts[1:] + have).tolist())
        have += len(got)

    for row in rows.toLocalIterator():
        lot.append((row.i, row.t))
        if len(lot) >= 1000:
            add(lot)
            lot = []
            if have >= block_words:
                yield np.array(ids), np.concatenate(words), np.array(ends)
                ids, words, ends, have = [], [], [0], 0
    if lot:
        add(lot)
    if ids:
        yield np.array(ids), np.concatenate(words), np.array(ends)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Benchmark passages in documents: doc_id, item_id, the runs' word places in both, equal words, words. Map-side only: one pass for each block of the benchmark."""
    rows, out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), None
    for ids, words, ends in blocks_of(benchmark, item_col, item_text, block_words):
        sent = docs.sparkSession.sparkContext.broadcast((ids, words, ends))

        def search(batches, sent=sent, name=uuid.uuid4().hex):
            block = ready(name, lambda: Block(*sent.value, masks))
            ids = block.ids
            for batch in common.text_slices(batches, "text", SLICE_BYTES, keeps="block"):
                got = matches(block, *normal_words(batch.column("text")), min_words, min_identity)
                if got:
                    text, item, *rest = (np.array(x) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text)), pa.array(ids[item], pa.int64()), *(pa.array(x, pa.int32()) for x in rest)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        part = rows.mapInArrow(search, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, block_words: int = BLOCK_WORDS, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, unchanged, that hold no benchmark passage. Map-side only."""
    for ids, words, ends in blocks_of(benchmark, item_col, item_text, block_words):
        sent = docs.sparkSession.sparkContext.broadcast((ids, words, ends))

        def without(batches, sent=sent, name=uuid.uuid4().hex):
            block = ready(name, lambda: Block(*sent.value, masks))
            for batch in common.text_slices(batches, text_col, SLICE_BYTES, keeps="block"):
                bad = {t for t, *_ in matches(block, *normal_words(batch.column(text_col)), min_words, min_identity)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)])) if bad else batch

        docs = docs.mapInArrow(without, docs.schema)
    return docs
