"""Token-ID output: a wavelet matrix for each shard.

A shard holds the token ids of a run of documents, in ascending order of their ids (null ids first).
Its sequence is kept as bit-planes, the highest bit first; at each level the sequence is parted, stably, into the ids with bit 0
and those with bit 1, so one file answers token access, counts (rank) and occurrence lookup (select) in one pass over the planes.

File (little-endian): b"QWM2", planes u8, 3 bytes of zero, documents u64, tokens u64; then zstd frames, each led by its length u64:
the token counts of the documents (u32), then three frames for each plane: its bits (the first in the highest bit of a byte, up to whole blocks of 512), the ones before each 4096 bits (u32), and the ones
before each 512 bits from there (u16). The directory is 4 % of the bits; with it rank takes a few steps and select a binary search, both on the packed bits.
The shards are written by Spark's Parquet writer, one row for each, so that a lost executor leaves no half shard.

Edge cases: null and empty texts hold the end id only; a very long text is in one shard, which is as large as it has to be; an empty table gives no shards and no rows; repeated rows and ties of the document id
are all kept, in any order among themselves; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common

MAGIC = b"QWM2"
END_ID = 1
#: Tokens after which a shard is closed; one document is never split.
SHARD_TOKENS = 1 << 20
#: Distinct words and pieces whose ids a worker remembers.
CACHE_WORDS = 500_000
#: Text bytes that are encoded at once, beside one whole text.
SLICE_BYTES = common.SLICE_BYTES // 4
#: The pre-tokenizer's pattern, for texts that the fast way takes.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Outside these characters the library's own normalizer and pre-tokenizer are run.
SLOW = r"[^\t-\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{17f}]|<\|"


def byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by the tokenizers library.

    White space and the pattern above part this kind of tokenizer's pieces, and a piece's ids depend on it alone. So the new pieces of plain Latin texts
    go through the library's model many at a time, and words are remembered with their ids; any other text goes through the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters, self.words = byte_letters(), {}
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        probe = "Zwölf Boxkämpfer, ça n'a 42 pièces: it's Eñe!! x_y-z  \n| Über |"
        try:
            self.fast = self.plain(pa.array([probe]))[0].tobytes() == self.direct(probe).tobytes()
        except (ValueError, KeyError):
            self.fast = False  # this tokenizer is of another kind

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Ids of new words. A piece is a word of its own, too."""
        known = self.words
        cut = {w: PIECES.findall(w) for w in words if not w.isalpha()}
        new = {p for pieces in cut.values() for p in pieces if p not in known}
        new.update(w for w in words if w not in cut)
        new = list(new)
        for at in range(0, len(new), 1000):
            lot = new[at : at + 1000]
            ids = np.array(self.bare.encode(" ".join(p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in lot), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            whole, start = ids.tobytes(), 0
            for piece, end in zip(lot, (4 * ends).tolist(), strict=True):
                known[piece] = whole[start:end]
                start = end
        get = known.__getitem__
        for word, pieces in cut.items():
            if len(pieces) > 1:
                known[word] = b"".join(map(get, pieces))

    def plain(self, texts: pa.Array) -> list[np.ndarray]:
        words, ends = common.split_words(pc.utf8_lower(texts), lower=False)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() makes a scalar of each first
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        self.learn([w for w in distinct if w not in self.words])
        ids = pa.array(list(map(self.words.__getitem__, distinct)), pa.large_binary()).take(coded.indices)  # one after the other, as the words are
        stop = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] // 4
        out = np.frombuffer(ids.buffers()[2] or b"", "<u4", count=int(stop[-1]))
        cuts = stop[ends]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers (null: none)."""
        texts = pc.fill_null(texts, "")
        slow = pc.match_substring_regex(texts, SLOW).to_numpy(zero_copy_only=False) if self.fast else np.ones(len(texts), bool)
        if not slow.any():
            return self.plain(texts)
        fast = iter(self.plain(texts.filter(pa.array(~slow))))
        return [self.direct(texts[i].as_py()) if slow[i] else next(fast) for i in range(len(texts))]


_encoders: dict[str, Encoder] = common.kept("encoder")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Bits of a block, whose ones are counted one by one, and of a superblock.
BLOCK, SUPER = 512, 4096


def directory(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ones before each superblock (u32), and before each block within its superblock (u16). packed: whole blocks."""
    ones = np.bitwise_count(packed).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(ones)])[:-1]
    supers = before[:: SUPER // BLOCK]
    return supers.astype("<u4"), (before - np.repeat(supers, SUPER // BLOCK)[: len(before)]).astype("<u2")


def packed_bits(on: np.ndarray) -> np.ndarray:
    """Bits in bytes, filled up to whole blocks, of which there is one at least."""
    out = np.zeros(max(1, -(-len(on) // BLOCK)) * (BLOCK // 8), np.uint8)
    bits = np.packbits(on)
    out[: len(bits)] = bits
    return out


def build(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A shard's file."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    pack = zstandard.ZstdCompressor(level=1).compress
    frames, now = [pack(counts.astype("<u4").tobytes())], ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for level in range(planes - 1, -1, -1):
        bit = (now >> np.array(level, now.dtype)) & np.array(1, now.dtype)
        on = bit.astype(bool)
        packed = packed_bits(on)
        frames += [pack(packed.tobytes()), *(pack(d.tobytes()) for d in directory(packed))]
        if level:
            now = np.concatenate([now[~on], now[on]])
    return MAGIC + struct.pack("<B3xQQ", planes, len(counts), len(ids)) + b"".join(struct.pack("<Q", len(f)) + f for f in frames)


class Plane:
    """A level's bits, kept packed, with its directory: rank in a constant number of steps, select by binary search in the directory."""

    def __init__(self, bits: bytes, supers: bytes, blocks: bytes, n: int):
        self.bits, self.supers, self.blocks, self.n = np.frombuffer(bits, np.uint8), np.frombuffer(supers, "<u4"), np.frombuffer(blocks, "<u2"), n
        self.zeros = n - self.ones(n)

    def __getitem__(self, i: int) -> int:
        return int(self.bits[i >> 3]) >> (7 - (i & 7)) & 1

    def ones(self, i: int) -> int:
        """The ones before place i."""
        if i >= len(self.bits) * 8:
            i, more = i - 1, self[i - 1]
        else:
            more = 0
        block = i // BLOCK
        out = int(self.supers[i // SUPER]) + int(self.blocks[block]) + int(np.bitwise_count(self.bits[block * (BLOCK // 8) : i >> 3]).sum())
        return out + more + (int(self.bits[i >> 3]) >> (8 - (i & 7))).bit_count()

    def select(self, on: int, k: int) -> int:
        """The place of the one (or zero) number k, from 0."""
        of_super = lambda s: int(self.supers[s]) if on else s * SUPER - int(self.supers[s])
        top = bisect.bisect_right(range(len(self.supers)), k, key=of_super) - 1
        k -= of_super(top)
        first, end = top * (SUPER // BLOCK), min((top + 1) * (SUPER // BLOCK), len(self.blocks))
        of_block = lambda b: int(self.blocks[b]) if on else (b - first) * BLOCK - int(self.blocks[b])
        block = first + bisect.bisect_right(range(first, end), k, key=of_block) - 1
        k -= of_block(block)
        bits = np.unpackbits(self.bits[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])
        return block * BLOCK + int(np.flatnonzero(bits == on)[k])

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=self.n)


class Shard:
    """A shard's file, opened: its planes stay packed, and what is asked is answered from them and their directories."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        levels, self.n_docs, self.n = struct.unpack_from("<B3xQQ", data, 4)
        at, unpack, frames = 24, zstandard.ZstdDecompressor().decompress, []
        while at < len(data):
            size = struct.unpack_from("<Q", data, at)[0]
            frames.append(unpack(data[at + 8 : at + 8 + size]))
            at += 8 + size
        self.counts = np.frombuffer(frames[0], "<u4").astype(np.int64)
        self.planes = [Plane(*frames[1 + 3 * i : 4 + 3 * i], self.n) for i in range(levels)]

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for plane in self.planes:
            on, ones = plane[i], plane.ones(i)
            token = token << 1 | on
            i = plane.zeros + ones if on else i - ones
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the id's occurrences before place end stand below the lowest plane."""
        at = 0
        for level, plane in enumerate(self.planes):
            before, upto = plane.ones(at), plane.ones(end)
            at, end = (plane.zeros + before, plane.zeros + upto) if token >> (len(self.planes) - 1 - level) & 1 else (at - before, end - upto)
        return at, end

    def rank(self, token: int, end: int) -> int:
        """How often the id stands before place end."""
        if token >> len(self.planes):
            return 0
        at, end = self._range(token, min(max(end, 0), self.n))
        return end - at

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the id's occurrence number k, from 0."""
        if token >> len(self.planes):
            raise IndexError(k)
        at, end = self._range(token, self.n)
        if not 0 <= k < end - at:
            raise IndexError(k)
        at += k
        for level, plane in reversed(list(enumerate(self.planes))):
            on = token >> (len(self.planes) - 1 - level) & 1
            at = plane.select(on, at - plane.zeros if on else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids: from the lowest plane up, each level's parting undone."""
        levels = len(self.planes)
        now = np.zeros(self.n, np.uint16 if levels <= 16 else np.uint32)
        for level, plane in reversed(list(enumerate(self.planes))):
            bits = plane.unpacked()
            if level == levels - 1:
                now = bits.astype(now.dtype)
            else:
                on, up = bits.view(bool), np.empty_like(now)
                up[~on] = now[: plane.zeros]
                up[on] = now[plane.zeros :] | np.array(1 << (levels - 1 - level), now.dtype)
                now = up
        return now


SHARDS = "part int, seq int, docs array<bigint>, n_docs bigint, n_tokens bigint, payload binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write the shards to path, in ascending order of (part, seq)."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, counts, docs, have, end = [], [], [], 0, np.array([end_id], "<u4")

        def close():
            nonlocal ids, counts, docs, have, seq
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([len(docs)], pa.int64()), pa.array([have], pa.int64()), pa.array([build(np.concatenate(ids), np.array(counts))], pa.binary())], names=["part", "seq", "docs", "n_docs", "n_tokens", "payload"])
            ids, counts, docs, have, seq = [], [], [], 0, seq + 1
            return row

        for batch in common.text_slices(batches, "text", SLICE_BYTES, keeps="encoder"):
            for doc, got in zip(batch.column("doc").to_pylist(), encode(batch.column("text")), strict=True):
                ids += [got, end]
                counts.append(len(got) + 1)
                docs.append(doc)
                have += len(got) + 1
                if have >= shard_tokens:
                    yield close()
        if docs:
            yield close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    rows.repartitionByRange(n, "doc").sortWithinPartitions("doc").mapInArrow(shards, SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """For each document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, docs, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "docs", "payload")), strict=True):
                shard = Shard(payload)
                ids, ends = shard.tokens().astype("<u4"), np.cumsum(shard.counts)
                starts = ends - shard.counts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(docs, pa.int64()), pa.array(starts), pa.array(shard.counts), pa.array(np.array(crc, np.int64))], names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    # sums before: of the parts (as many as partitions), then within a part
    heads = shards.select("part", "seq", "n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    before = heads.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("before")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("before_part")).alias("before"))
    docs = shards.select("part", "seq", "docs", "payload").mapInArrow(decode, "part int, seq int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, token: int) -> DataFrame:
    """part, seq, n, places (from the shard's start) of an id, for each shard that has it: from the shards' bit-planes, which are not decoded."""
    shards = spark.read.schema(SHARDS).parquet(path).select("part", "seq", "payload")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "payload")), strict=True):
                if places := Shard(payload).occurrences(token):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(places)], pa.int64()), pa.array([places], pa.list_(pa.int64()))], names=["part", "seq", "n", "places"])

    return shards.mapInArrow(find, "part int, seq int, n bigint, places array<bigint>")


def encode_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    path = common.new_path(docs.sparkSession, "shards")
    write_shards(docs, path, tokenizer, **options)
    return read_shards(docs.sparkSession, path)
