"""Jaccard join of word shingles by parity sketches.

A text's set: its distinct runs of `width` words (with fewer words, the whole as one). Two sets A, B link when |A & B| >= t * |A | B|, and then
|A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|), which is at most (1 - t) / t * |A| for the smaller set A.

Sketch. A set's shingles are dealt by hash into the blocks of its size band and XORed within each block; equal shingles of two sets cancel, so the number of blocks that
differ, and the Hamming distance of a bit sketch in which each shingle flips one bit, are lower bounds of |A ^ B|.

Pigeonhole. If A has more non-empty blocks than |A ^ B| may be, one of them is the same in B. So sets meet in (band, block, XOR) keys. Sets of the next band that may be partners
also send the keys of this band. Sets under `SMALL` shingles use as many blocks as there are hashes: each shingle is a key.

Eligible sets. A linked pair shares at least tau of each set's keys of the band they meet in, so a set with fewer than tau shared keys has no partner and goes at once: most texts share a few common phrases only.

Hot keys. Common lines make keys that thousands of unrelated sets share. If fewer than tau of the smaller set's keys are hot, a pair also shares a cold one, and the hot ones need no search. Sets whose keys are nearly
all hot (large groups of near copies, short texts with a long common header) are searched by a second pigeonhole: with any order of all shingles, the first n / 7 + 1 shingles of the smaller set and the first n / 4 + 1 of
the larger have one in common. Frequent shingles, by a table of counts of a fixed size, come last in that order, so what many sets share is a key only where it is nearly all of a set, which is where sets link.

Large groups. Every key first links its sets with its least one (pairs in proportion to rows). Those links, verified, give components; keys within one component are done. In a few rounds more each set meets one set of
another component for each key, and then only pairs across the components that are left are looked at, filtered by size and Hamming distance within the join. Equal sets are one node from the start.

Every reported link is verified on the whole shingle sets (64-bit hashes). A result's class is its connected component.

A row is known by its id and a hash of its text, so different texts under one id are different rows.

Edge cases: null or empty texts, or without words: no shingles, linked with nothing, component_id is the own id; rows with a null id get their count and a null component; repeated rows (and copies) share a component;
rows of one id with different texts are classed one by one; very long texts are whole sets, in bands of their own size; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.components import connected_components

WIDTH = 5
#: The threshold, as a fraction: 75 of 100.
NUM, DEN = 3, 4
SMALL = 64
#: Sets that share a key from which it is hot.
HOT = 64
SKETCH_BITS = 1024
#: Text bytes that a step holds at once, beside one whole text.
SLICE_BYTES = common.SLICE_BYTES // 4
#: Rounds in which sets meet one set of another component for each key.
TURNS = 2
#: Counters (a power of two) by which frequent shingles are told in the second pigeonhole, and how many times the mean makes one frequent.
COUNTERS, FREQUENT = 1 << 20, 8
#: Keys for a bucket, about: it is sorted by one task at once.
BUCKET_KEYS = 800_000


def shingle_sets(texts: pa.Array, width: int = WIDTH, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of each text, ascending, and where each text's begin."""
    words, ends = common.split_words(texts)
    hashed = common.hash_strings(words)
    hashed = common.mix(hashed + np.uint64(seed)) if seed else hashed
    runs = common.window_hashes(hashed, width)
    out, cuts = [], [0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= width:
            own = runs[a : b - width + 1]
            own = np.sort(own)
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            own = common.mix(common.window_hashes(hashed[a:b], b - a, 7) + np.uint64(b - a))
        else:
            own = runs[:0]
        out.append(own)
        cuts.append(cuts[-1] + len(own))
    return (np.concatenate(out) if out else runs[:0]), np.array(cuts)


def sums(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.append(x, np.uint64(0)), np.minimum(cuts[:-1], len(x))) * (cuts[1:] > cuts[:-1]).astype(x.dtype)


def nodes_of(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set."""
    return common.mix(sums(common.mix(hashes ^ np.uint64(0xA5A5A5A5)), cuts) + sums(common.mix(hashes + np.uint64(77)), cuts) * np.uint64(0x9E3779B97F4A7C15) + np.diff(cuts).astype(np.uint64))


def band_of(size: int) -> int:
    """0 for sets under SMALL, then a band for each power of two."""
    return 0 if size < SMALL else size.bit_length()


def blocks_in(band: int) -> int:
    """Blocks of a band that begins at L shingles: 1.5 L under 512, L from there."""
    least = 1 << (band - 1)
    return least * 3 // 2 if least < 512 else least


def bands(size: int) -> list[tuple[int, bool]]:
    """(band, whether it is the set's own) of the keys that a set sends."""
    own = band_of(size)
    lower = band_of(-(-size * NUM // DEN))
    return [(own, True)] if lower == own else [(own, True), (lower, False)]


def block_keys(own: np.ndarray, band: int) -> np.ndarray:
    """The keys of a set's non-empty blocks."""
    if not band:
        return common.mix(own)
    block = ((own >> np.uint64(32)) * np.uint64(blocks_in(band))) >> np.uint64(32)  # ascending, as the hashes are
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    return common.mix(np.bitwise_xor.reduceat(own, first) + block[first] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band))


def slack(size: int) -> int:
    """The most that a set may differ from a partner at least as large."""
    return size * (DEN - NUM) // NUM


def sketch(own: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def long_bits(size: int) -> int:
    """Bits of the sketch that is compared last: enough for the most that partners of this size differ by to stand out."""
    return max(SKETCH_BITS, 1 << (size - 1).bit_length()) if size else SKETCH_BITS


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two sketches; the longer one is folded to the shorter's length, which keeps it a lower bound."""
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(-1, n), axis=0) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp (a hash of the text as it is), text."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("fp"), F.col(f"`{text_col}`").alias("text"))


def set_rows(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """doc_id, fp, n_shingles, node, blocks and lower (keys in its own band and the one below), sketch (array of longs)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = SKETCH_BITS // 64
        for batch in common.text_slices(batches, "text", SLICE_BYTES):
            hashes, cuts = shingle_sets(batch.column("text"), width, seed)
            size, sent, bits = np.diff(cuts), [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sent.append([len(block_keys(hashes[a:b], band)) for band, _ in bands(b - a)] if b > a else [0])
                bits.append(np.frombuffer(sketch(hashes[a:b]), np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bits) * longs + 1, longs), pa.int32()), pa.array(np.concatenate(bits)))
            blocks, lower = (common.longs(np.array([x[i] if len(x) > i else 0 for x in sent])) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), common.longs(size), common.longs(nodes_of(hashes, cuts)), blocks, lower, flat], names=["doc_id", "fp", "n_shingles", "node", "blocks", "lower", "sketch"])

    return docs.mapInArrow(rows, "doc_id bigint, fp bigint, n_shingles bigint, node bigint, blocks bigint, lower bigint, sketch array<bigint>")


def key_rows(docs: DataFrame, width: int, seed: int, buckets: int) -> DataFrame:
    """Keys of all sets, dealt into buckets: (bucket, keys: u32 each, and runs of keys of one set and band: nodes, and runs: u32 length with the high bit for the set's own band)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text", SLICE_BYTES):
            hashes, cuts = shingle_sets(batch.column("text"), width, seed)
            nodes = nodes_of(hashes, cuts)
            keys, owners, seen = [], [], set()
            has_id = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if a == b or not has_id[i] or (name := int(nodes[i])) in seen:
                    continue
                seen.add(name)
                for band, own in bands(b - a):
                    found = block_keys(hashes[a:b], band)
                    keys.append(found)
                    owners.append(np.full(len(found), i | own << 15, np.uint16))
            if not keys:
                continue
            key, owner = np.concatenate(keys), np.concatenate(owners)
            to = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(to, kind="stable")
            to, key, owner = to[order], key[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            out: list[list] = [[], [], [], []]
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(to)], strict=True):
                own = owner[a:b]  # in runs, as the sort is stable
                start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                out[0].append(int(to[a]))
                out[1].append((key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                out[2].append((np.diff(np.append(start, len(own))).astype(np.uint32) | (own[start] >> np.uint16(15)).astype(np.uint32) << np.uint32(31)).tobytes())
                out[3].append(nodes[own[start] & np.uint16(0x7FFF)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "keys", "runs", "nodes"])

    return docs.mapInArrow(rows, "bucket int, keys binary, runs binary, nodes binary")


SHARED = "key bigint, node bigint, own boolean, sets int, least bigint"


def shared_of(key: np.ndarray, node: np.ndarray, own: np.ndarray) -> pa.Table:
    """SHARED rows of the keys that several sets have: the sets that share a key, and the least of them."""
    order = np.lexsort((node, key))
    k, n, o = key[order], node[order], own[order]
    at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])]))  # the same set from several batches
    o = np.maximum.reduceat(o, at) if len(at) else o
    k, n = k[at], n[at]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(first, len(k)))
    group, least = np.repeat(size, size), np.repeat(n[first], size)
    on = group > 1
    return pa.table({"key": pa.array(k[on]), "node": pa.array(n[on]), "own": pa.array(o[on].astype(bool)), "sets": pa.array(group[on].astype(np.int32)), "least": pa.array(least[on])})


def shared_keys(keys: DataFrame) -> DataFrame:
    """SHARED rows of dealt keys."""

    def bucket(table: pa.Table) -> pa.Table:
        number = table.column("bucket")[0].as_py()
        key, node, own = [], [], []
        for k, r, n in zip(*(table.column(c).to_pylist() for c in ("keys", "runs", "nodes")), strict=True):
            r, n = np.frombuffer(r, np.uint32), np.frombuffer(n, np.uint64)
            key.append(np.frombuffer(k, np.uint32))
            node.append(np.repeat(n, r & np.uint32(0x7FFFFFFF)))
            own.append(np.repeat((r >> np.uint32(31)).astype(np.uint8), r & np.uint32(0x7FFFFFFF)))
        found = np.concatenate(key).astype(np.int64) | np.int64(number) << np.int64(32)
        key.clear()
        common.trim()  # of the bucket before
        return shared_of(found, np.concatenate(node).view(np.int64), np.concatenate(own))

    return keys.groupBy("bucket").applyInArrow(bucket, SHARED)


def shared_again(rows: DataFrame) -> DataFrame:
    """SHARED rows, counted anew."""

    def bucket(table: pa.Table) -> pa.Table:
        return shared_of(*(table.column(c).to_numpy() for c in ("key", "node")), table.column("own").to_numpy().astype(np.uint8))

    return rows.groupBy(F.shiftright("key", 32)).applyInArrow(bucket, SHARED)


def eligible(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """node, own: sets with tau shared keys at least in the band."""
    counts = shared.groupBy("node", "own").agg(F.count("*").alias("c"))
    n = F.col("n")
    least = F.ceil(n * NUM / DEN)  # where each shingle is a key
    own = F.when(n < SMALL, least).otherwise(F.col("blocks") - F.floor(n * (DEN - NUM) / NUM))
    lower = F.when(F.ceil(n * NUM / DEN) < SMALL, least).otherwise(F.col("lower") - F.floor(2 * n * (DEN - NUM) / (DEN + NUM)))
    return counts.join(sets.select("node", "n", "blocks", "lower"), "node").where(F.col("c") >= F.when(F.col("own"), own).otherwise(lower)).select("node", "own")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those that link; both sets are made again from the whole texts of the nodes' first rows."""
    wanted = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id"), "fp", "node")

    def made(batches):
        for batch in common.text_slices(batches, "text", SLICE_BYTES):
            hashes, cuts = shingle_sets(batch.column("text"), width, seed)
            bits = [sketch(hashes[a:b], long_bits(b - a)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            sets = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), common.longs(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("node"), common.longs(np.diff(cuts)), pa.array(bits, pa.binary()), sets], names=["want", "n", "bits", "hashes"])

    wanted = common.few(wanted, common.BROADCAST_IDS)
    texts = docs.join(wanted, ["doc_id", "fp"]).select("node", "text")
    found = common.shared_table(texts.mapInArrow(made, "want bigint, n bigint, bits binary, hashes array<bigint>").dropDuplicates(["want"]), "sets")

    def with_both(pairs: DataFrame, *columns: str) -> DataFrame:
        """Pairs with columns of both sets, as x_ and y_."""
        side = lambda own, s: found.select(F.col("want").alias(own), *[F.col(c).alias(f"{s}_{c}") for c in columns])
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    def near(batches):
        """Pairs whose long sketches are near enough, so that large sets that are not are never laid side by side."""
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("x_n", "y_n", "x_bits", "y_bits")), strict=True)
            ok = [(DEN + NUM) * distance(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))) <= (DEN - NUM) * (m.as_py() + n.as_py()) for m, n, x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = common.shared_table(with_both(pairs, "n", "bits").select("a", "b", "x_n", "y_n", "x_bits", "y_bits").mapInArrow(near, "a bigint, b bigint"), "near")
    # whole sets are compared within the JVM, row by row: a batch of pairs of sets would be held twice
    both = with_both(left, "n", "hashes").select("a", "b", "x_n", "y_n", F.size(F.array_intersect("x_hashes", "y_hashes")).alias("n"))
    out = common.shared_table(both.where(DEN * F.col("n") >= NUM * (F.col("x_n") + F.col("y_n") - F.col("n"))).select("a", "b"), "verified")
    common.drop_table(found, left)
    return out


def spanning(rows: DataFrame) -> DataFrame:
    """Rows of the keys that still span components and are cold, or searched by a set that needs its hot keys. rows: key, node, sets, component, searches."""
    keys = rows.groupBy("key").agg(F.max("sets").alias("most"), F.bool_or("searches").alias("searched"), (F.min("component") != F.max("component")).alias("spans"))
    return rows.join(keys.where(f"spans and (most <= {HOT} or searched)").select("key"), "key")


def hot_pairs(nodes: DataFrame, sets: DataFrame, docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(a, b) of nodes whose first shingles have one in common: all pairs that link among nodes (node, component) of different components, and few others."""
    wanted = common.few(sets.join(nodes, "node").select(F.col("rep").alias("doc_id"), "fp", "node"), common.BROADCAST_IDS)
    texts = docs.join(wanted, ["doc_id", "fp"]).select("node", "text")

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in common.text_slices(batches, "text", SLICE_BYTES):
            total += np.bincount((shingle_sets(batch.column("text"), width, seed)[0] & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(total[at[i : i + 100_000]])], names=["counter", "n"])

    counts = common.shared_table(texts.mapInArrow(count, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")), "counters")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / COUNTERS
    frequent = np.zeros(COUNTERS, bool)
    for r in counts.where(F.col("n") > max(HOT, FREQUENT * mean)).select("counter").toLocalIterator():  # COUNTERS rows at most
        frequent[r.counter] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent).tobytes())

    def firsts(batches):
        last = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in common.text_slices(batches, "text", SLICE_BYTES):
            hashes, cuts = shingle_sets(batch.column("text"), width, seed)
            often = last[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
            key, node, small = [], [], []
            for name, a, b in zip(batch.column("node").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                n = b - a
                probe = np.lexsort((hashes[a:b], often[a:b]))[: n // DEN + 1]  # n - ceil(3 n / 4) + 1 of the larger set
                key.append(hashes[a:b][probe])
                node.append(np.full(len(probe), name, np.int64))
                small.append(np.arange(len(probe)) < n * (DEN - NUM) // (DEN + NUM) + 1)  # n - ceil(6 n / 7) + 1 of the smaller
            yield pa.RecordBatch.from_arrays([common.longs(np.concatenate(key)), pa.array(np.concatenate(node)), pa.array(np.concatenate(small))], names=["key", "node", "small"])

    keyed = common.shared_table(texts.mapInArrow(firsts, "key bigint, node bigint, small boolean").dropDuplicates(["key", "node"]), "firsts")
    # a key of one component only is done
    spans = keyed.join(nodes, "node").groupBy("key").agg((F.min("component") != F.max("component")).alias("spans")).where("spans").select("key")
    keyed = keyed.join(spans, "key").join(sets.select("node", F.struct("n", "sketch").alias("x")), "node").join(nodes, "node")
    keyed = common.shared_table(keyed.select("key", "node", "small", "component", "x"), "spanning")
    p = keyed.where("small").select("key", F.col("node").alias("a"), F.col("component").alias("c"), F.col("x").alias("p"))
    q = keyed.select(F.col("key").alias("k"), F.col("node").alias("b"), "component", F.col("x").alias("q"))
    fit = p.join(q, (F.col("key") == F.col("k")) & F.expr(f"c != component and p.n <= q.n and {may_link('p', 'q')}"))
    return fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def may_link(a: str, b: str) -> str:
    """SQL: sizes fit and the sketches are near enough."""
    near = " + ".join(f"bit_count({a}.sketch[{i}] ^ {b}.sketch[{i}])" for i in range(SKETCH_BITS // 64))
    return f"{DEN} * least({a}.n, {b}.n) >= {NUM} * greatest({a}.n, {b}.n) and {DEN + NUM} * ({near}) <= {DEN - NUM} * ({a}.n + {b}.n)"


def grouped(docs: DataFrame, width: int = WIDTH, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: doc_id, fp, text. (doc_id, fp, n_shingles, node) of every row; (node, rep, component) of every set, component being the least node; the verified links (a, b) between nodes."""
    seed = 0
    while True:
        rows = common.shared_table(set_rows(docs, width, seed), "rows")
        if not rows.where(f"n_shingles >= {SMALL} and blocks <= floor(n_shingles * {DEN - NUM} / {NUM})").limit(1).count():
            break
        common.drop_table(rows)  # a set whose shingles fall into too few blocks for the pigeonhole: other hashes
        seed += 1
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    keys = key_rows(docs, width, seed, max(1, int(total * 0.8) // bucket_keys))
    every = common.shared_table(shared_keys(keys), "shared")
    sets = rows.where("doc_id is not null and n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "fp")).alias("first"), *[F.first(c).alias(d) for c, d in (("n_shingles", "n"), ("blocks", "blocks"), ("lower", "lower"), ("sketch", "sketch"))])
    sets = common.shared_table(sets.select("node", F.col("first.doc_id").alias("rep"), F.col("first.fp").alias("fp"), "n", "blocks", "lower", "sketch"), "sets_of")
    stay = common.few(eligible(every, sets), common.BROADCAST_IDS)
    shared = common.shared_table(shared_again(every.join(stay, ["node", "own"]).select("key", "node", "own")), "kept")
    common.drop_table(every)
    known = common.shared_table(sets.join(stay.select("node").distinct(), "node", "left_semi"), "known")
    side = lambda x: known.select(F.col("node").alias(x), F.struct("n", "sketch").alias(f"{x}_x"))
    pairs = shared.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    pairs = common.shared_table(pairs.join(side("a"), "a").join(side("b"), "b").where(may_link("a_x", "b_x")).select("a", "b"), "candidates")
    if not some(pairs) and not some(shared.where("node != least")):
        return rows.select("doc_id", "fp", "n_shingles", "node"), sets.select("node", "rep", F.col("node").alias("component")), pairs
    links = verified(pairs, known, docs, width, seed) if some(pairs) else pairs
    found = connected_components(links)
    label = known.select("node", "n", "blocks").join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    hot = shared.where(f"own and sets > {HOT}").groupBy("node").agg(F.count("*").alias("hot"))
    tau = F.when(F.col("n") < SMALL, F.col("n") - F.floor(F.col("n") * (DEN - NUM) / (DEN + NUM))).otherwise(F.col("blocks") - F.floor(F.col("n") * (DEN - NUM) / NUM))
    label = common.shared_table(label.join(hot, "node", "left").select("node", "component", (F.coalesce("hot", F.lit(0)) >= tau).alias("searches")), "labels")
    rest = common.shared_table(spanning(shared.select("key", "node", "sets").join(label, "node")), "labelled")
    common.drop_table(shared, label)
    # some rounds in which each set meets one set of another component for each key, whatever it is: what many sets would link with a component is one pair then
    for turn in range(TURNS):
        pivot = rest.groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("pivot"))
        pairs = rest.join(pivot, "key").where("component != pivot.component").select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()
        pairs = common.shared_table(pairs.join(side("a"), "a").join(side("b"), "b").where(may_link("a_x", "b_x")).select("a", "b"), "candidates")
        if not some(pairs):
            break
        links = links.unionByName(verified(pairs, known, docs, width, seed))
        found, old = connected_components(links), rest
        again = rest.drop("component").join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        rest = common.shared_table(spanning(again.select("key", "node", "sets", "component", "searches")), "labelled")
        common.drop_table(old, pairs)
    if some(rest):
        more = across(rest, known, docs, width, seed)
        common.drop_table(rest)
        if some(more):
            links = links.unionByName(verified(more, known, docs, width, seed))
            found = connected_components(links)
    of = sets.select("node", "rep").join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "fp", "n_shingles", "node"), of, links


def some(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


def across(rest: DataFrame, known: DataFrame, docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(a, b) of nodes of different components that share a key and may link. rest: key, node, sets, component, searches of keys that span components."""
    spans = rest.groupBy("key").agg(F.max("sets").alias("sets"), F.bool_or("searches").alias("searched"))
    cold = rest.join(spans.where(f"sets <= {HOT}").select("key"), "key").join(known.select("node", F.struct("n", "sketch").alias("x")), "node")
    cold = common.shared_table(cold.select("key", "node", "component", "x"), "open")
    p = cold.select(F.col("key").alias("k"), F.col("node").alias("a"), F.col("component").alias("c"), F.col("x").alias("p"))
    q = cold.select("key", F.col("node").alias("b"), "component", F.col("x").alias("q"))
    more = p.join(q, (F.col("k") == F.col("key")) & F.expr(f"a < b and c != component and {may_link('p', 'q')}")).select("a", "b").distinct()
    searched = common.shared_table(rest.join(spans.where(f"sets > {HOT} and searched").select("key"), "key").select("node", "component").distinct(), "searched")
    if some(searched):
        more = more.unionByName(hot_pairs(searched, known, docs, width, seed))
    more = common.shared_table(more.distinct(), "more")
    common.drop_table(cold)
    return more


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) of every row, and the verified links (a, b) between representatives of different sets."""
    rows, of, links = grouped(rows_of(docs, id_col, text_col), width, bucket_keys)
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = rows.where("doc_id is not null and n_shingles > 0").join(of.join(least, "component").select("node", "component_id"), "node").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rep = lambda x: of.select(F.col("node").alias(x), F.col("rep").alias(f"{x}_rep"))
    named = links.join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    return linked.unionByName(alone), named


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, unchanged, but of each class only one: the first by id, then by the text's hash. Rows are told apart by id and text, so rows that share an id only are not dropped for it;
    of rows equal in both one stays. Rows without an id or without words link with nothing and all stay."""
    rows, of, _ = grouped(rows_of(docs, id_col, text_col), **options)
    rows = rows.where("doc_id is not null and n_shingles > 0").join(of.select("node", "component"), "node").select("doc_id", "fp", "component")
    rows = common.shared_table(rows, "classed")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "fp")).alias("first"))
    drop = rows.join(first, "component").where(F.struct("doc_id", "fp") != F.col("first")).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).distinct()
    key, fp = F.col(f"`{id_col}`").cast("bigint"), F.xxhash64(F.col(f"`{text_col}`"))
    same = lambda other: (key == other["__id"]) & (fp == other["__fp"])
    drop = common.few(drop, common.BROADCAST_IDS)
    out = docs.join(drop, same(drop), "left_anti")
    twice = common.shared_table(rows.groupBy(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")).agg(F.count("*").alias("n")).where("n > 1").select("__id", "__fp"), "twice")
    if twice.limit(1).count():
        again = out.join(twice, same(twice), "left_semi").dropDuplicates([id_col, text_col])
        out = out.join(twice, same(twice), "left_anti").unionByName(again)
    return out
