"""Token-ID output: segments of ids with Elias-Fano encoded document boundaries.

Documents are dealt in ranges of doc_id and sorted within each range, encoded, and
written as segments of about :data:`SEGMENT_IDS` ids: one binary record each, kept
in Parquet files under a folder that all executors share (Spark's own commit
makes the write safe against lost executors). A segment stores its ids as one
array of 2 or 4 bytes each; document ends and doc_ids are monotone sequences in
Elias-Fano form (about 2 + log2(u/n) bits a document) with sampled select
positions, so no table of 64-bit offsets exists. Reading needs the ids before a
segment: prefix sums over the segments of a range, and over ranges.

The tokenizers library encodes. The pre-tokens of a byte-level vocabulary are
encoded apart from each other, so each Python worker splits texts with array
operations and asks the library only for pre-tokens that it hasn't met lately.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, common

#: Ids after which a segment is closed, and remembered pre-tokens a worker.
SEGMENT_IDS, REMEMBERED = 1 << 18, 1 << 20
#: Code points that are split and encoded at once (a longer text alone), and pre-tokens asked at once.
CHUNK_POINTS, ASKED = 1 << 19, 1 << 13
#: Bytes of a page and a row group of the written files; every row, a whole segment, is looked at.
FILE_OPTIONS = {
    "compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.size": str(1 << 20),
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
    "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.enable.dictionary": "false",
}
#: Every so many-th one bit has its position sampled for select.
SAMPLE = 64
MAGIC = b"EFIDS001"
FILE_SCHEMA = "shard int, seq int, n_docs bigint, n_ids bigint, data binary"
_U = arrays.U64


# ---------------------------------------------------------------- Elias-Fano


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Non-negative integers as ``width`` bits each, lowest first."""
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little")
    return bits.reshape(n, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high parts in unary,
    every SAMPLE-th one bit's position kept for ``select``."""

    HEAD = struct.Struct("<QBIII")

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> width) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").tobytes()
        return cls(n, width, pack_bits(values & ((1 << width) - 1), width), high, ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.width, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, width, low, high, samples = cls.HEAD.unpack_from(data, at)
        at += cls.HEAD.size
        a, b, c = at + low, at + low + high, at + low + high + 4 * samples
        return cls(n, width, data[at:a], data[a:b], np.frombuffer(data[b:c], "<u4")), c

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.width) | unpack_bits(self.low, self.n, self.width)

    def select(self, i: int) -> int:
        """The i-th value, read from its sample on: a bounded part of both arrays."""
        start = int(self.samples[i // SAMPLE])
        stop = int(self.samples[i // SAMPLE + 1]) + 1 if i // SAMPLE + 1 < len(self.samples) else len(self.high) * 8
        part = np.unpackbits(np.frombuffer(self.high[start // 8 : (stop + 7) // 8], np.uint8), bitorder="little")
        ones = np.flatnonzero(part[start % 8 :])
        high = start + int(ones[i % SAMPLE]) - i
        first = i * self.width
        value = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8 + 1], "little") >> (first % 8)
        return (high << self.width) | (value & ((1 << self.width) - 1))


# ------------------------------------------------------------------ segments


def write_segment(doc_ids: np.ndarray, nulls: int, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One binary record: header, doc_ids (after ``nulls`` rows without one), ends, ids."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    first = int(doc_ids[0]) if len(doc_ids) else 0
    head = MAGIC + struct.pack("<BIqQ", width, nulls, first, len(ids))
    known = EliasFano.of((doc_ids - first).astype(np.int64)).to_bytes()
    return head + known + EliasFano.of(ends).to_bytes() + ids.astype(f"<u{width}").tobytes()


class Segment:
    """A read segment: ``doc_ids`` (None for null), ``ends`` (Elias-Fano) and ``ids``."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment of token ids")
        width, nulls, first, n = struct.unpack_from("<BIqQ", data, len(MAGIC))
        known, at = EliasFano.read(data, len(MAGIC) + struct.calcsize("<BIqQ"))
        self.doc_ids = [None] * nulls + (known.all() + first).tolist()
        self.ends, at = EliasFano.read(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", n, at)

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.ends.select(k - 1) if k else 0 : self.ends.select(k)]


# ------------------------------------------------------------------ encoding

_SPACE, _BLANK, _LETTER, _NUMBER, _OTHER, _END = range(6)
#: White space of the pattern, but for the blank, and code points up to which the split is done here.
_WHITE = (*range(9, 14), 0x85, 0xA0)
_KNOWN = 0x250
_END_POINT = 0x110000


def _classes() -> np.ndarray:
    import unicodedata

    kinds = np.full(_KNOWN, _OTHER, np.uint8)
    for c in range(_KNOWN):
        kind = unicodedata.category(chr(c))[0]
        kinds[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    kinds[list(_WHITE)] = _SPACE
    kinds[32] = _BLANK
    return kinds


def split_points(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens that the byte-level pattern (contractions;
    letters, numbers or others with one blank before; white space) finds. Every text
    is followed by ``_END_POINT``."""
    n = len(points)
    kind = np.where(points == _END_POINT, _END, kinds[np.minimum(points, _KNOWN - 1)]).astype(np.uint8)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = _END, kind[:-1]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = _END, kind[1:]
    white, solid = kind <= _BLANK, (kind > _BLANK) & (kind < _END)
    start = (white & ((before > _BLANK) | ((after > _BLANK) & (after < _END)))) | (
        solid & (kind != before) & (before != _BLANK)
    )
    marks = np.flatnonzero(start & (points == 39) & (after == _LETTER))
    if len(marks):
        one = points[np.minimum(marks + 1, n - 1)]
        two = points[np.minimum(marks + 2, n - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        for found, size in ((marks[single], 2), (marks[double], 3)):
            start[found + 1] = False
            rest = found + size
            start[rest[kind[rest] == _LETTER]] = True
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(kind == _END)
    following = np.append(starts[1:], n)
    return starts, np.minimum(following, ends[np.searchsorted(ends, starts)])


class PreTokens:
    """Ids of pre-tokens by a 64-bit hash, asked from the library once and kept in
    sorted arrays; past REMEMBERED entries only the latest batch's are kept."""

    def __init__(self, path: str):
        # a task has one core: the library's threads, one a core of the machine, would each hold memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kinds = _classes()
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, _U), np.zeros(0, np.int64)
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def lookup(self, hashes: np.ndarray, text_of) -> np.ndarray:
        """Slots of sorted distinct hashes; ``text_of(i)`` is the i-th one's pre-token."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        if len(self.hashes) + int((~known).sum()) > REMEMBERED and len(self.hashes):
            self._clear()
            return self.lookup(hashes, text_of)
        new = np.flatnonzero(~known)
        if len(new):
            sizes, ids = self._ask(text_of, new)
            slots = len(self.offsets) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
            self.hashes = np.insert(self.hashes, at[new], hashes[new])
            self.slots = np.insert(self.slots, at[new], slots)
            at = np.searchsorted(self.hashes, hashes)
        return self.slots[at]

    def _ask(self, text_of, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of new pre-tokens, a bounded number at once: the library's result holds many times a
        pre-token's size (its texts, offsets and masks)."""
        sizes, ids = [], []
        for begin in range(0, len(new), ASKED):
            part = [text_of(i) for i in new[begin : begin + ASKED]]
            found = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(ids)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text, one after the other, and the texts' offsets. Texts with
        special tokens or code points past the known ones go to the library whole."""
        joined = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        strange = np.searchsorted(at, np.flatnonzero(joined >= _KNOWN), side="right") - 1
        whole = np.zeros(len(texts), bool)
        whole[np.unique(strange)] = True
        for k, t in enumerate(texts):
            whole[k] |= any(s in t for s in self.special)
        parts: dict[int, np.ndarray] = {}
        picked = np.flatnonzero(whole)
        if len(picked):
            for k, e in zip(picked, self.library.encode_batch_fast([texts[k] for k in picked], add_special_tokens=False), strict=True):
                parts[k] = np.array(e.ids, np.uint32)
        plain = np.flatnonzero(~whole)
        sizes = np.diff(at)[plain]
        points = np.full(int(sizes.sum()) + len(plain), _END_POINT, np.uint32)
        to = np.append(0, np.cumsum(sizes + 1))
        points[arrays.ranges(to[:-1], sizes)] = joined[arrays.ranges(at[:-1][plain], sizes)]
        counts = np.zeros(len(texts), np.int64)
        ids = np.zeros(0, np.uint32)
        if len(plain):
            starts, ends = split_points(points, self.kinds)
            hashes = arrays.span_hashes(points, starts, ends)
            order, first = arrays.grouped(hashes)
            pick = order[first]
            raw = np.where(points == _END_POINT, 0, points).astype("<u4")
            slots = self.lookup(hashes[pick], lambda i: raw[starts[pick[i]] : ends[pick[i]]].tobytes().decode("utf-32-le"))
            slot = np.empty(len(starts), np.int64)
            slot[order] = np.repeat(slots, np.diff(np.append(first, len(order))))
            tokens = (self.offsets[1:] - self.offsets[:-1])[slot]
            ids = self.ids[arrays.ranges(self.offsets[:-1][slot], tokens)]
            upto = np.append(0, np.cumsum(tokens))[np.searchsorted(starts, to)]
            counts[plain] = np.diff(upto)
        if not parts:
            return ids, np.append(0, np.cumsum(counts))
        for k, x in parts.items():
            counts[k] = len(x)
        offsets = np.append(0, np.cumsum(counts))
        out = np.empty(int(offsets[-1]), np.uint32)
        out[arrays.ranges(offsets[:-1][plain], counts[plain])] = ids
        for k, x in parts.items():
            out[offsets[k] : offsets[k + 1]] = x
        return out, offsets


_loaded: dict[str, PreTokens] = {}


def pre_tokens_of(path: str) -> PreTokens:
    """The tokenizer, loaded once a Python worker."""
    if path not in _loaded:
        _loaded[path] = PreTokens(path)
    return _loaded[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of the rows in order, of at most CHUNK_POINTS code points or one text: the
    arrays of an encoding take many times the text's size, in every worker of an executor."""
    for batch in batches:
        doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        begin, points = 0, 0
        for k, text in enumerate(texts):
            if k > begin and points + len(text) > CHUNK_POINTS:
                yield doc_ids[begin:k], texts[begin:k]
                begin, points = k, 0
            points += len(text)
        if texts:
            yield doc_ids[begin:], texts[begin:]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, as segments in
    ascending doc_id (then text hash) order; rows without doc_id come first. A null
    text is empty and has the end id alone; repeated rows are written as often."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty("text").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    names = ["shard", "seq", "n_docs", "n_ids", "data"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seq = pre_tokens_of(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            doc_ids = [x for h in held for x in h[0]]
            counts, ids = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            known = np.array([x for x in doc_ids if x is not None], np.int64)
            data = write_segment(known, len(doc_ids) - len(known), np.cumsum(counts), ids)
            values = [[shard], [seq], [len(doc_ids)], [len(ids)], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for doc_ids, texts in chunks(batches):
            ids, at = encoder.encode_batch(texts)
            ended = np.insert(ids, at[1:], end_id)
            counts = np.diff(at) + 1
            # close after the document that fills a segment
            upto = np.append(0, np.cumsum(counts))
            begin = 0
            while begin < len(counts):
                have = sum(len(h[2]) for h in held)
                stop = int(np.searchsorted(upto, upto[begin] + SEGMENT_IDS - have)) if have < SEGMENT_IDS else begin + 1
                stop = min(max(stop, begin + 1), len(counts))
                held.append((doc_ids[begin:stop], counts[begin:stop], ended[upto[begin] : upto[stop]]))
                begin = stop
                if sum(len(h[2]) for h in held) >= SEGMENT_IDS:
                    yield close()
                    held, seq = [], seq + 1
        if held:
            yield close()

    dealt.mapInArrow(segments, FILE_SCHEMA).write.options(**FILE_OPTIONS).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids of all documents before
    it), n_tokens and ids_crc32 (of its ids as little-endian 32-bit integers)."""
    common.small_batches(spark)
    stored = spark.read.schema(FILE_SCHEMA).parquet(folder)
    sizes = stored.select("shard", "seq", "n_ids")
    # prefix sums: over the segments of a shard, and over the shards (one row each)
    in_order = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(in_order), F.lit(0)))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    all_before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("before"))
    base = inside.join(shards, "shard").select("shard", "seq", (F.col("inside") + F.col("before")).alias("base"))
    names = ["shard", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch.column("data")[k].as_py())
                ends = segment.ends.all()
                starts = np.append(0, ends)[:-1]
                ids = segment.ids.astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                same = [pa.array(np.full(len(ends), batch.column(c)[k].as_py()), pa.int32()) for c in ("shard", "seq")]
                longs = [pa.array(x, pa.int64()) for x in (segment.doc_ids, starts, ends - starts, crcs)]
                yield pa.RecordBatch.from_arrays([*same, *longs], names=names)

    schema = "shard int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    found = stored.select("shard", "seq", "data").mapInArrow(documents, schema)
    return found.join(base, ["shard", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "token-files")
    write(common.read(spark, sf_dir, "documents", ["doc_id", "text"]), folder, default_tokenizer())
    return read(spark, folder)
