"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

log P(token | history) = log P(class | history) + log P(token | class, history). The class softmax has n-gram and skip features of the history, folded to SYMBOLS symbols: the word before, the word before that (skip) and both,
hashed to `2 ** BITS` rows of weights.

Both softmaxes are then refined by the history's whole words: classes, and the words of each class, are the leaves of a tree of binary decisions (by Huffman, so a token takes few). A decision's log odds are those of the class softmax (between
classes) or of the counts (within a class), plus the weights of its n-gram, skip and joint features, hashed with the decision to at most `2 ** MOST_SLOT_BITS` weights. So all probabilities of a history sum to one without a sum over words.

Classes: the end, the most frequent words one by one, further frequent words by their hashed endings, and one class for all words beyond the `VOCABULARY` most frequent. Words of that class have
their count from a join with the count table of the whole training corpus, so counts are exact however rare a word is; only the frequent words are sent to every task.

Training: one pass counts words; one pass counts classes after histories, the sufficient statistics of the whole corpus, of at most 2 ** 16 histories. Gradients are then taken over that table, distributed,
summed by weight row and applied on the driver (a bounded number of weights); each row's step is scaled by its counts. The decisions' weights take one step, of the gradients and curvatures
that a pass over all texts sums by weight (two half steps cost twice as much and did no better on texts held out).

Edge cases: null and empty texts have the end only; very long texts are scored whole, as one row of sums; without training documents every count is 0 and the base gives each token probability 1; an empty table gives no rows; repeated rows are learned from and
scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common

VOCABULARY = 1 << 18
BITS = 14
SINGLE, ENDINGS = 63, 63
CLASSES = 1 + SINGLE + ENDINGS + 1
RARE = CLASSES - 1
#: History symbols: end or start, frequent words, endings of other words.
SYMBOLS, KNOWN_BEFORE = 256, 192
STEPS, RATE, PRIOR = 8, 0.6, 4.0
#: Weights of the decisions: as many as training tokens, within these bounds; how their step is held back.
LEAST_SLOT_BITS, MOST_SLOT_BITS = 12, 21
SLOT_PRIOR, SLOT_BOUND = 4.0, 0.5
#: Weights of a block, which is summed at once; tokens whose decisions are held at once.
BLOCK, TOKENS = 1 << 12, 1 << 12
END = "\n"


@dataclass(frozen=True)
class Lexicon:
    """What every task knows of the frequent words, by falling count."""

    words: pa.Array
    counts: np.ndarray
    total: int  # N, all training tokens
    distinct: int  # V

    def classes(self) -> np.ndarray:
        return classes_of(self.words)

    def rare_mass(self) -> float:
        return self.total - float(self.counts.sum()) + 0.1 * (self.distinct - len(self.words) + 1)


def endings_of(words: pa.Array) -> np.ndarray:
    """A number below ENDINGS for each word, from its last two letters."""
    coded = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    numbers = np.array([zlib.crc32(w.encode()) % ENDINGS for w in coded.dictionary.to_pylist()], np.int64)
    return numbers[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)


def classes_of(words: pa.Array) -> np.ndarray:
    """The class of each frequent word (in order of falling count)."""
    out = 1 + SINGLE + endings_of(words)
    out[:SINGLE] = 1 + np.arange(min(SINGLE, len(words)))
    at = pc.index(words, END).as_py() if len(words) else -1
    if at >= 0:
        out[at] = 0
    return out


class Tokens:
    """Tokens of a slice of texts, ends included."""

    def __init__(self, texts: pa.Array, lexicon: Lexicon):
        words, ends = common.split_words(texts)
        docs = len(ends) - 1
        coded = words.dictionary_encode()
        place = np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(ends))
        self.stops = ends[1:] + np.arange(1, docs + 1)
        self.starts = np.concatenate([[0], self.stops[:-1]])
        n, of = len(words) + docs, coded.indices.to_numpy() if len(words) else np.zeros(0, np.int64)
        distinct = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])])
        self.distinct, self.word = distinct, np.full(n, len(distinct) - 1)
        self.word[place] = of
        found = pc.fill_null(pc.index_in(distinct, value_set=lexicon.words), -1).to_numpy() if len(lexicon.words) else np.full(len(distinct), -1)
        self.known = found[self.word]  # number of the frequent word, or -1
        classes = lexicon.classes()
        self.classes = np.append(classes, RARE)[found][self.word]
        symbol = np.where((found >= 0) & (found < KNOWN_BEFORE), 1 + found, 1 + KNOWN_BEFORE + endings_of(distinct) % (SYMBOLS - 1 - KNOWN_BEFORE))
        symbol[-1] = 0
        symbol = symbol[self.word]
        one = np.concatenate([[0], symbol[:-1]])  # the end of the text before is this one's start
        two = np.concatenate([[0, 0], symbol[:-2]])[:n]
        two[self.starts] = 0
        self.history = two * SYMBOLS + one
        self.leaf = np.where(self.known < 0, len(lexicon.words), self.known)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of each token's n-gram, skip and joint feature, from whole words."""
        whole = common.hash_strings(self.distinct)[self.word]
        one = np.concatenate([whole[-1:], whole[:-1]])  # the last token of a slice is an end
        two = np.concatenate([one[:1], one[:-1]])
        two[self.starts] = whole[-1:]
        one, two = common.mix(one + np.uint64(1)), common.mix(two + np.uint64(2))
        return one, two, common.mix(one + two)


def feature_rows(history: np.ndarray) -> np.ndarray:
    """Weight rows of each history: n-gram, skip and joint feature. Row 0 is the bias."""
    one, two = (history % SYMBOLS).astype(np.uint64), (history // SYMBOLS).astype(np.uint64)
    keys = np.stack([one + np.uint64(1 << 20), two + np.uint64(1 << 21), history.astype(np.uint64) + np.uint64(1 << 22)], axis=1)
    return np.concatenate([np.zeros((len(history), 1), np.int64), 1 + (common.mix(keys) % np.uint64((1 << BITS) - 1)).astype(np.int64)], axis=1)


def log_softmax(history: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = weights[feature_rows(history)].sum(axis=1, dtype=np.float64)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def huffman(mass: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """For the leaves 0 to n - 1 and the joints n to 2 n - 2, which is the root: the joint above (root: -1) and the side there; for the joints: log odds of side 1."""
    n, order, mass = len(mass), np.argsort(mass, kind="stable").tolist(), mass.tolist()
    up, side, odds, i, j = [-1] * (2 * n - 1), [0] * (2 * n - 1), np.zeros(n - 1), 0, n
    for joint in range(n, 2 * n - 1):
        two = []
        for s in (0, 1):
            if i < n and (j >= joint or mass[order[i]] <= mass[j]):
                x, i = order[i], i + 1
            else:
                x, j = j, j + 1
            up[x], side[x] = joint, s
            two.append(mass[x])
        mass.append(two[0] + two[1])
        odds[joint - n] = np.log(two[1] / two[0])
    return up, side, odds


@dataclass(frozen=True)
class Tree:
    """The decisions of each frequent word, and of the rare class as one leaf more. Decisions 0 to CLASSES - 2 are between classes."""

    path: np.ndarray  # 2 * decision + side, leaf by leaf
    first: np.ndarray  # of each leaf, with the end
    odds: np.ndarray  # log odds of side 1 by counts
    sides: np.ndarray  # of side, class and decision between classes: whether the class is there

    @classmethod
    def of(cls, lexicon: Lexicon) -> Tree:
        classes, n = lexicon.classes(), len(lexicon.words)
        mass = np.bincount(classes, weights=lexicon.counts, minlength=CLASSES) + 0.5
        mass[RARE] += lexicon.rare_mass()
        up, side, odds = huffman(mass)
        up = np.array(up) - CLASSES
        leaf_up, leaf_side = np.full(n + 1, up[RARE]), np.full(n + 1, side[RARE])
        ups, sides, all_odds, joints = [up[CLASSES:]], [side[CLASSES:]], [odds], CLASSES - 1
        ups[0][-1] = -1
        for c in np.unique(classes).tolist():
            words = np.flatnonzero(classes == c)
            k = len(words)
            above, at, odds = huffman(lexicon.counts[words])
            above = np.array(above) - k + joints
            above[-1], at[-1] = up[c], side[c]  # the root hangs where the class does
            leaf_up[words], leaf_side[words] = above[:k], at[:k]
            ups.append(above[k:])
            sides.append(at[k:])
            all_odds.append(odds)
            joints += k - 1
        ups, sides = np.concatenate(ups).astype(np.int64), np.concatenate(sides).astype(np.int64)

        def paths(at, on):
            leaf, leaves, steps = np.arange(len(at)), [], []
            while len(leaf):
                leaves.append(leaf)
                steps.append(2 * at + on)
                on, at = sides[at], ups[at]
                on, leaf, at = on[at >= 0], leaf[at >= 0], at[at >= 0]
            leaves = np.concatenate(leaves)
            return leaves[order := np.argsort(leaves, kind="stable")], np.concatenate(steps)[order]

        leaves, path = paths(leaf_up, leaf_side)
        between = np.zeros((2, CLASSES, CLASSES - 1))
        of, steps = paths(up[:CLASSES], np.array(side[:CLASSES]))
        between[steps % 2, of, steps // 2] = 1
        return cls(path.astype(np.int32), np.searchsorted(leaves, np.arange(n + 2)), np.concatenate(all_odds).astype(np.float32), between)

    def between(self, by_class: np.ndarray) -> np.ndarray:
        """Log odds of the decisions between classes, from log probabilities of the classes."""
        out = np.empty((len(by_class), CLASSES - 1), np.float32)
        for at in range(0, len(by_class), 4096):
            p = np.exp(by_class[at : at + 4096])
            out[at : at + 4096] = np.log(np.maximum(p @ self.sides[1], 1e-30)) - np.log(np.maximum(p @ self.sides[0], 1e-30))
        return out


def decisions(leaf: np.ndarray, contexts: tuple, history: np.ndarray, between: np.ndarray, tree: Tree, bits: int, slots: np.ndarray | None):
    """Where each token's decisions begin; for each decision: the side taken, the log odds of side 1, and the weights' numbers. history: the row of between."""
    first = tree.first.take(leaf)
    n = tree.first.take(leaf + 1) - first
    stop = np.cumsum(n)
    step = tree.path.take(np.arange(stop[-1]) + np.repeat(first - (stop - n), n))
    node, side = step >> 1, (step & 1).astype(bool)
    z = tree.odds.take(node)
    high = np.flatnonzero(node < CLASSES - 1)
    z[high] = between.ravel().take(np.repeat(history * (CLASSES - 1), n).take(high) + node.take(high))
    keys, shift = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    numbers = []
    for context in contexts:
        at = (((np.repeat(context, n) ^ keys) * np.uint64(0xD6E8FEB86659FD93)) >> shift).view(np.int64)
        if slots is not None:
            z += slots.take(at)
        numbers.append(at)
    return stop - n, side, z, numbers


def each_decision(tokens: Tokens, weights: np.ndarray, tree: Tree, bits: int, slots: np.ndarray | None = None):
    """decisions() of a slice, some tokens at a time, with the number of the first."""
    contexts = tokens.contexts()
    history, at = np.unique(tokens.history, return_inverse=True)
    between = np.concatenate([tree.between(log_softmax(history[i : i + 4096], weights)) for i in range(0, len(history), 4096)])
    for a in range(0, len(at), TOKENS):
        part = slice(a, a + TOKENS)
        yield a, *decisions(tokens.leaf[part], [c[part] for c in contexts], at[part], between, tree, bits, slots)


def log_chance(side: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The log probability of the sides taken, given the log odds of side 1."""
    x = np.where(side, -z, z)
    return -np.maximum(x, 0) - np.log1p(np.exp(-np.abs(x)))


def log_probability(tokens: Tokens, weights: np.ndarray, tree: Tree, slots: np.ndarray) -> np.ndarray:
    """Of each token after its history; of rare ones, of their class."""
    out = np.empty(len(tokens.leaf))
    for a, first, side, z, _ in each_decision(tokens, weights, tree, len(slots).bit_length() - 1, slots):
        out[a : a + len(first)] = np.add.reduceat(log_chance(side, z), first)
    return out


def train_slots(docs: DataFrame, lexicon, weights, tree, bits: int) -> np.ndarray:
    """Weights of the decisions' features, from whole texts: a step from no weights. lexicon, weights, tree: broadcast."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by weight, over all decisions with it: how much oftener side 1 was taken than expected (real) and the curvature (imaginary), which are added at once
        total = np.zeros(1 << bits, np.complex128)
        for batch in common.text_slices(batches, "text", common.SLICE_BYTES // 2):
            tokens = Tokens(batch.column("text"), lexicon.value)
            for _, _, side, z, numbers in each_decision(tokens, weights.value, tree.value, bits):
                p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                x = np.empty(len(z), np.complex128)
                x.real, x.imag = side - p, p * (1 - p)
                for at in numbers:
                    np.add.at(total, at, x)
        for i in range(0, 1 << bits, BLOCK):
            if total[i : i + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i : i + BLOCK].astype(np.complex64).tobytes()], pa.binary())], names=["block", "total"])

    def step(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.complex64).astype(np.complex128) for c in t.column("total").chunks for x in c)
        move = total.real / (total.imag + SLOT_BOUND * np.abs(total.real) + SLOT_PRIOR)
        return pa.table({"block": t.column("block").slice(0, 1), "total": pa.array([move.astype(np.float32).tobytes()], pa.binary())})

    schema, slots = "block int, total binary", np.zeros(1 << bits, np.float32)
    # a task's sums are of a bounded size, so there are as many tasks as cores
    parts = docs.select("text").coalesce(max(1, docs.sparkSession.sparkContext.defaultParallelism)).mapInArrow(sums, schema)
    for r in parts.groupBy("block").applyInArrow(step, schema).toLocalIterator():  # 2 ** MOST_SLOT_BITS / BLOCK rows at most
        slots[r.block : r.block + BLOCK] = np.frombuffer(bytes(r.total), np.float32)
    return slots


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over whole texts; END for the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text", 2 * common.SLICE_BYTES):
            words, _ = common.split_words(batch.column("text"))
            got = words.value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([got.field(0).cast(pa.string()), pa.array([END])]), pa.concat_arrays([got.field(1), pa.array([batch.num_rows], pa.int64())])], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count_histories(docs: DataFrame, lexicon) -> DataFrame:
    """history, class, n over whole texts. A task's sums are of a bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS * CLASSES, np.int32)
        for batch in common.text_slices(batches, "text"):
            tokens = Tokens(batch.column("text"), lexicon.value)
            cell, n = np.unique(tokens.history * CLASSES + tokens.classes, return_counts=True)
            total[cell] += n.astype(np.int32)
        cell = np.flatnonzero(total)
        for at in range(0, len(cell), 200_000):
            c = cell[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array((c // CLASSES).astype(np.int32)), pa.array((c % CLASSES).astype(np.int32)), pa.array(total[c].astype(np.int64))], names=["history", "class", "n"])

    return docs.select("text").mapInArrow(count, "history int, class int, n bigint").groupBy("history", "class").agg(F.sum("n").alias("n"))


def train(counts: DataFrame, steps: int = STEPS, rate: float = RATE, prior: float = PRIOR) -> np.ndarray:
    """Weights of the class softmax. counts: history, class, n."""
    by_history = counts.groupBy("history").agg(F.collect_list(F.struct("class", "n")).alias("seen"))
    table = common.shared_table(by_history, "histories")
    weights = np.zeros((1 << BITS, CLASSES), np.float32)
    share = {r["class"]: r.n for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    if not share:
        return weights
    weights[0] = np.log([(share.get(c, 0) + 0.5) / (sum(share.values()) + 0.5 * CLASSES) for c in range(CLASSES)])
    sc = table.sparkSession.sparkContext

    def sums(sent=None) -> np.ndarray:
        """By weight row and class, over all histories: how often a class was seen, or how often the weights expect it."""

        def of_part(batches):
            total = np.zeros((1 << BITS, CLASSES))
            for batch in batches:
                history = batch.column("history").to_numpy().astype(np.int64)
                cells = batch.column("seen")
                n = np.zeros((len(history), CLASSES))
                flat, ends = cells.flatten(), cells.offsets.to_numpy()
                n[np.repeat(np.arange(len(history)), np.diff(ends)), flat.field("class").to_numpy()] = flat.field("n").to_numpy()
                rows = feature_rows(history)
                for at in range(0, len(history), 4096):
                    part = slice(at, at + 4096)
                    x = n[part] if sent is None else np.exp(log_softmax(history[part], sent.value)) * n[part].sum(axis=1, keepdims=True)
                    for f in range(rows.shape[1]):
                        order = np.argsort(rows[part, f], kind="stable")
                        row = rows[part, f][order]
                        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                        total[row[first]] += np.add.reduceat(x[order], first)
            blocks = total.astype(np.float32).reshape(-1, 256 * CLASSES)
            for i in np.flatnonzero(blocks.any(axis=1)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blocks[i].tobytes()], pa.binary())], names=["block", "total"])

        def add(t: pa.Table) -> pa.Table:
            whole = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for c in t.column("total").chunks for x in c)
            return pa.table({"block": t.column("block").slice(0, 1), "total": pa.array([whole.astype(np.float32).tobytes()], pa.binary())})

        schema, out = "block int, total binary", np.zeros((1 << BITS, CLASSES), np.float32).reshape(-1, 256 * CLASSES)
        for r in table.coalesce(max(1, sc.defaultParallelism)).mapInArrow(of_part, schema).groupBy("block").applyInArrow(add, schema).toLocalIterator():  # 2 ** BITS / 256 rows at most
            out[r.block] = np.frombuffer(bytes(r.total), np.float32)
        return out.reshape(1 << BITS, CLASSES)

    seen = sums()
    for _ in range(steps):
        sent = sc.broadcast(weights)
        expected = sums(sent)
        weights = weights + rate * (seen - expected) / (np.maximum(seen, expected) + prior)
        sent.unpersist()
    return weights.astype(np.float32)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """Learn from the rows where `learn` holds; for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = common.shared_table(count_words(rows.where("learn")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
    words, n = top.column("word").combine_chunks(), top.column("n").to_numpy()
    words = words if isinstance(words, pa.Array) else pa.array([], pa.string())
    lexicon = Lexicon(words.cast(pa.string()), n, total, distinct)
    sent = spark.sparkContext.broadcast(lexicon)
    histories = common.shared_table(count_histories(rows.where("learn"), sent), "cells")
    weights = spark.sparkContext.broadcast(train(histories))
    tree = spark.sparkContext.broadcast(Tree.of(lexicon))
    bits = min(max(int(total).bit_length(), LEAST_SLOT_BITS), MOST_SLOT_BITS)
    slots = spark.sparkContext.broadcast(train_slots(rows.where("learn"), sent, weights, tree, bits))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        base = np.append(np.log10(lexicon.counts + 0.1), 0.0)  # of rare words: joined later
        in_rare = -np.log10(lexicon.rare_mass())
        for batch in common.text_slices(batches, "text"):
            tokens = Tokens(batch.column("text"), lexicon)
            rare = tokens.known < 0
            lp = log_probability(tokens, weights.value, tree.value, slots.value) / np.log(10) + in_rare * rare
            each = lambda x: np.add.reduceat(x, tokens.starts)
            n_rare = each(rare.astype(np.int64))
            of = tokens.distinct.take(pa.array(tokens.word[rare]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32)), of)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("learn"), pa.array(tokens.stops - tokens.starts), pa.array((tokens.stops - tokens.starts) - n_rare), pa.array(each(base[tokens.known])), pa.array(each(lp)), lists], names=["doc_id", "learn", "n_tokens", "n_known", "base", "model", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    told = rows.mapInArrow(sums, f"doc_id {kind}, learn boolean, n_tokens bigint, n_known bigint, base double, model double, rare array<string>")
    told = common.shared_table(told.withColumn("row", F.monotonically_increasing_id()), "sums")
    rare = told.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = told.drop("rare").join(rare, "row", "left")
    logs, per_token = F.coalesce("logs", F.lit(0.0)), float(np.log10(total + 0.1 * (distinct + 1)))
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") + logs - F.col("n_tokens") * per_token).alias("base_score"), (F.col("model") + logs).alias("score"))
