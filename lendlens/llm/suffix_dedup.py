"""Suffix-array dedup with a run-length index.

Every byte covered by a MATCH-byte string that also starts elsewhere is found, in
any document or the same one, without bringing the corpus to one place:

1. Anchors. A MATCH-byte window's anchor is the GRAM-byte string inside it with the
   smallest hash (leftmost among equals). Equal windows have equal anchors at equal
   offsets. The windows of one anchor are neighbours; the bytes that they cover
   are the anchor's context. Only hashes of anchors and contexts are shuffled, and
   combined map-side: a passage in a third of all documents is one row a task.
2. Equal contexts are counted, not compared. An anchor with one context found twice
   or more repeats wholly; one found once is done; the texts of the different
   contexts of one anchor go to a run-length index.
3. Index. Contexts that share neither the bytes before nor those after their anchor
   with another one are left out. The others of many anchors, INDEX_BYTES at most, are sorted as suffixes;
   the Burrows-Wheeler transform is kept as runs with the text places of run ends
   as samples. Only at run ends are neighbouring suffixes compared; inside a run the
   matching statistics stream along the text, falling by one from byte to byte.
   Where they reach MATCH, the window repeats.
4. An anchor whose different contexts exceed INDEX_BYTES is refined: its windows are
   halved by their offset to the anchor, and the bytes that all windows of a half
   cover join the key, until a part fits (at the last, a key is a whole window).

Passages of PASSAGE words may be shorter than MATCH bytes; they are counted, never
removed. Their windows have anchors of PHRASE words by the same rule; only windows
whose anchor stands in different texts are hashed whole and compared.
"""

from __future__ import annotations

import collections
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common

#: Length of a repeated string, of an anchor, and bytes of one index.
MATCH, GRAM, INDEX_BYTES = 400, 32, 1 << 20
#: Words of a passage and of its anchor.
PASSAGE, PHRASE = 51, 8
_HALF = (MATCH - GRAM) // 2
_U = arrays.U64
_PLACE_BITS = 24
_IS_WORD = np.ones(256, dtype=bool)  # as common.WORD_PATTERN
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _doubled(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Hashes of the 2^k bytes from every place on, for the last two lengths asked for."""
    at, size, kept = data.astype(_U) + _U(1), 1, {}
    while size < upto:
        at = at[:-size] * _U(0x9E3779B97F4A7C15 + 2 * size) + at[size:] * _U(0xC2B2AE3D27D4EB4F)
        at ^= at >> _U(31)
        size *= 2
        if size in (GRAM, upto):
            kept[size] = at
    return kept


def anchors(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The anchors of a batch of texts: text number, place, first and last window start
    (all within the text), anchor hash and context hash."""
    none = {k: np.zeros(0, np.int64) for k in ("doc", "place", "low", "high", "h", "c")}
    if len(data) < MATCH:
        return none
    hashes = _doubled(data, 256)
    gram, long = arrays.mix(hashes[GRAM]), hashes[256]
    return _runs(_least_places(gram, MATCH - GRAM + 1), offsets, gram, long)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _least_places(gram: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` neighbouring hashes, the place of the smallest (leftmost among
    equals): place and hash are packed into one word, in parts that overlap by a window."""
    step, places = (1 << _PLACE_BITS) - 4 * MATCH, []
    for begin in range(0, len(gram) - width + 1, step):
        part = gram[begin : begin + step + width - 1]
        packed = ((part >> _U(_PLACE_BITS)) << _U(_PLACE_BITS)) | np.arange(len(part), dtype=_U)
        places.append((_sliding_least(packed, width) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64) + begin)
    return np.concatenate(places)


def _neighbours(place, offsets, match) -> tuple[np.ndarray, ...]:
    """Neighbouring windows with one anchor, within each text: text number, the anchor's
    place, first and last window."""
    first, stop = offsets[:-1], np.maximum(offsets[1:] - match + 1, offsets[:-1])
    starts = arrays.ranges(first, stop - first)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    doc = np.repeat(np.arange(len(first)), stop - first)
    new = np.concatenate([[True], (place[starts[1:]] != place[starts[:-1]]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    low, high = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    return doc[at], place[low], low, high


def _runs(place, offsets, gram, long) -> dict[str, np.ndarray]:
    """The anchors of the windows of every text with hashes of their contexts."""
    doc, place, low, high = _neighbours(place, offsets, MATCH)
    end = high + MATCH - 256  # three strings of 256 bytes cover the context
    mid = np.minimum(low + 256, end)
    c = long[low] * _U(3) + arrays.mix(long[mid]) * _U(5) + arrays.mix(arrays.mix(long[end])) * _U(7)
    c = arrays.mix(c + (high - low).astype(_U) * _U(0x9E3779B97F4A7C15) + (place - low).astype(_U))
    own = offsets[doc]
    return {
        "doc": doc, "place": place - own, "low": low - own, "high": high - own,
        "h": gram[place].view(np.int64), "c": c.view(np.int64),
    }


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from every place on."""
    out, held, power = None, 0, 1
    while True:
        if size & power:
            if out is None:
                out = words
            else:
                n = len(words) - held
                out = out[:n] * _U(0x9E3779B97F4A7C15) + words[held : held + n]
                out ^= out >> _U(31)
            held += power
        if held == size:
            return arrays.mix(out)
        words = words[:-power] * _U(0xC2B2AE3D27D4EB4F) + words[power:]
        words ^= words >> _U(29)
        power *= 2


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The words of every text of a batch."""
    word = _IS_WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = word[first]
    return np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


def phrases(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The anchors of the passages of a batch of texts: text number, first and last window
    (words of the batch), anchor hash; and of the batch: hashes of the windows from every
    word on, first words of the texts."""
    starts, ends = arrays.word_bounds(_IS_WORD[data], offsets)
    at = np.searchsorted(starts, offsets)
    if len(starts) < PASSAGE:
        none = np.zeros(0, np.int64)
        return {"doc": none, "low": none, "high": none, "h": none, "windows": none, "first": at}
    words = arrays.span_hashes(data, starts, ends)
    phrase = _rolled(words, PHRASE)
    doc, place, low, high = _neighbours(_least_places(phrase, PASSAGE - PHRASE + 1), at, PASSAGE)
    windows = _rolled(words, PASSAGE).view(np.int64)
    return {"doc": doc, "low": low, "high": high, "h": phrase[place].view(np.int64), "windows": windows, "first": at}


# ------------------------------------------------------------------ the index


class RunIndex:
    """Run-length Burrows-Wheeler index of a text of at most INDEX_BYTES or one context
    more: run heads and lengths, text places at both ends of every run, and, by
    the prefix ranks of the sort, lengths of common extensions."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        self.n, self.symbols = n, symbols
        bits = _U(max(1, int(n - 1).bit_length()))
        mask = (_U(1) << bits) - _U(1)
        index = np.arange(n, dtype=_U)
        padded = np.concatenate([symbols.astype(_U), np.zeros(3, _U)])
        key = (padded[:n] << _U(27)) | (padded[1 : n + 1] << _U(18)) | (padded[2 : n + 2] << _U(9)) | padded[3 : n + 3]
        self.ranks: list[tuple[int, np.ndarray]] = []
        size = 4
        while True:
            packed = np.sort((key << bits) | index)
            order = (packed & mask).astype(np.int64)
            high = packed >> bits
            new = np.empty(n, np.uint32)
            new[0], new[1:] = 0, high[1:] != high[:-1]
            rank = np.empty(n, np.uint32)
            rank[order] = np.cumsum(new, dtype=np.uint32)
            self.ranks.append((size, rank))
            if size >= depth or int(new.sum()) == n - 1:
                break
            later = np.zeros(n, _U)
            later[: n - size] = rank[size:].astype(_U) + _U(1)
            key = (rank.astype(_U) << (bits + _U(1))) | later
            size *= 2
        before = symbols[order - 1]  # the transform; the text's first suffix takes its last symbol
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.heads, self.lengths = before[heads], np.diff(np.append(heads, n))
        tails = np.append(heads[1:], n) - 1
        self.first, self.last = order[heads], order[tails]  # samples at run ends

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j."""
        i, j, length = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for size, rank in reversed(self.ranks):
            same = (i < self.n) & (j < self.n)
            same[same] = (rank[i[same]] == rank[j[same]]) & (np.maximum(i[same], j[same]) + size <= self.n)
            step = np.where(same, size, 0)
            i, j, length = i + step, j + step, length + step
        for _ in range(3):
            same = (i < self.n) & (j < self.n)
            same[same] = self.symbols[i[same]] == self.symbols[j[same]]
            i, j, length = i + same, j + same, length + same
        return length

    def matching_statistics(self) -> np.ndarray:
        """For every place, the length of the longest string from there on that also
        starts elsewhere: compared at run ends, streamed in between."""
        statistics = np.zeros(self.n, np.int64)
        if len(self.heads) > 1:
            left, right = self.last[:-1], self.first[1:]
            shared = self.extension(left, right)
            np.maximum.at(statistics, left, shared)
            np.maximum.at(statistics, right, shared)

        at = np.arange(self.n)
        return np.maximum.accumulate(statistics + at) - at


def repeated_windows(contexts: list[bytes]) -> list[np.ndarray]:
    """For every context, the starts of the windows that also start elsewhere."""
    sizes = np.array([len(x) for x in contexts])
    depth = int(sizes.max()) + 1
    symbols = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.uint16)  # 0 comes first and ends every context
    starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    symbols[arrays.ranges(starts, sizes)] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    statistics = RunIndex(symbols, depth).matching_statistics()
    found = []
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        at = np.arange(n - MATCH + 1)
        found.append(np.flatnonzero(np.minimum(statistics[a + at], n - at) >= MATCH))
    return found


# ------------------------------------------------------------------- Spark


def anchor_table(docs: DataFrame) -> DataFrame:
    """A row for each anchor of every whole text: h, c, doc_id, text_hash, place, low, high."""
    common.small_batches(docs.sparkSession)
    names = ["h", "c", "doc_id", "text_hash", "place", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = anchors(*arrays.column_bytes(batch.column("text")))
            doc = pa.array(found["doc"])
            ids = [batch.column(c).take(doc) for c in ("doc_id", "text_hash")]
            values = [pa.array(found["h"]), pa.array(found["c"]), *ids]
            values += [pa.array(found[k].astype(np.int32)) for k in ("place", "low", "high")]
            yield pa.RecordBatch.from_arrays(values, names=names)

    schema = "h bigint, c bigint, doc_id bigint, text_hash bigint, place int, low int, high int"
    return common.stage(_rows(docs).mapInArrow(run, schema), "anchors")


def _rows(docs: DataFrame) -> DataFrame:
    text = common.text_or_empty("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _context_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (h, c, n, rep) with the bytes of each context, cut from its document."""
    lists = wanted.select("rep.*", "h", "c", "n").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("h", "c", "n", "place", "low", "high")).alias("wanted")
    )
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "wanted")
    rows = _rows(docs)
    met = rows.join(lists, rows["doc_id"].eqNullSafe(lists["_id"]) & (rows["text_hash"] == lists["_hash"]))
    # repeated rows of one document would give the same contexts again
    met = met.select(F.col("text").cast("binary").alias("text"), "wanted")
    names = ["key", "d", "h", "c", "n", "least", "most", "a", "b", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text, items in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                for x in items:
                    place, low, high = x["place"], x["low"], x["high"]
                    row = (x["h"], x["c"], x["h"], x["c"], x["n"], place - high, place - low, 0, MATCH - GRAM, text[low : high + MATCH])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.int32()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    return met.mapInArrow(cut, CONTEXT)


#: A context (or a part of one) under its key: d tells equal texts, (h, c) is the whole context, n how often it is
#: found, least..most the offsets of the anchor in its windows, a..b the offsets of its class.
CONTEXT = "key bigint, d bigint, h bigint, c bigint, n bigint, least int, most int, a int, b int, text binary"


def _hash(data: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Halve the class of every context by the offset of the anchor in its windows."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            mid = (x["a"] + x["b"]) // 2
            for a, b in ((x["a"], mid), (mid + 1, x["b"])):
                least, most = max(a, x["least"]), min(b, x["most"])
                if least > most:
                    continue
                zero = x["most"]  # the anchor's place in the text of the context
                text = x["text"][zero - most : zero - least + MATCH]
                core = x["text"][zero - a : zero - b + MATCH] if a < b else text
                key = _hash(core, x["key"] ^ (a << 32 | b))
                out.append(x | {"key": key, "d": _hash(text, key), "least": least, "most": most, "a": a, "b": b, "text": text})
        yield pa.RecordBatch.from_pylist(out, schema=batch.schema)


def _paired(keys: list[int], texts: list[bytes], most: list[int]) -> list[int]:
    """The contexts that may share a window with another one of their key: a window holds
    _HALF bytes before or after its anchor, so these stand in another context too."""
    sides = [
        ((k, "before", t[m - _HALF : m + GRAM] if m >= _HALF else None), (k, "after", t[m : m + GRAM + _HALF] if len(t) >= m + GRAM + _HALF else None))
        for k, t, m in zip(keys, texts, most, strict=True)
    ]
    count = collections.Counter(side for both in sides for side in both if side[-1] is not None)
    return [i for i, both in enumerate(sides) if any(count[side] > 1 for side in both)]


def _indexed(rows: DataFrame, size: int) -> DataFrame:
    """(key, d, u, v): offsets u..v of the anchor in windows that repeat, by the index."""
    buckets = max(1, -(-2 * size // INDEX_BYTES))

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending")])
        keys, texts, most = (table.column(c).to_pylist() for c in ("key", "text", "most"))
        ds, out = table.column("d").to_pylist(), ([], [], [], [])
        kept = _paired(keys, texts, most)
        keys, texts, most, ds = ([column[i] for i in kept] for column in (keys, texts, most, ds))
        begin = 0
        while begin < len(keys):  # whole keys until an index is full
            stop, held = begin, 0
            while stop < len(keys):
                end, more = stop, 0
                while end < len(keys) and keys[end] == keys[stop]:
                    more += len(texts[end]) + 1
                    end += 1
                if held and held + more > INDEX_BYTES:
                    break
                stop, held = end, held + more
            for k, found in zip(range(begin, stop), repeated_windows(texts[begin:stop]), strict=True):
                if len(found):
                    edge = np.flatnonzero(np.diff(found) > 1)
                    firsts, lasts = found[np.append(0, edge + 1)], found[np.append(edge, len(found) - 1)]
                    for x, y in zip(firsts.tolist(), lasts.tolist(), strict=True):
                        for column, value in zip(out, (keys[k], ds[k], most[k] - y, most[k] - x), strict=True):
                            column.append(value)
            begin = stop
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["key", "d", "u", "v"])

    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "d", "most", "text")
    return dealt.groupBy("bucket").applyInArrow(index, "key bigint, d bigint, u int, v int")


def repeated_offsets(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(h, c, u, v): of contexts c of anchors h, the offsets u..v of the anchor in
    windows that also start elsewhere."""
    counted = table.groupBy("h", "c").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "place", "low", "high")).alias("rep")
    )
    counted = common.stage(counted, "contexts")
    per_key = counted.groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("total > 1")
    per_key = common.stage(per_key.select(F.col("h").alias("_h"), "m"), "shared")
    shared = counted.join(per_key, F.col("h") == F.col("_h"))
    place = F.col("rep.place")
    parts = [
        shared.filter("m = 1").select("h", "c", (place - F.col("rep.high")).alias("u"), (place - F.col("rep.low")).alias("v"))
    ]
    several = shared.filter("m > 1")
    # of a text found twice or more every window repeats; it still is in the index for the others
    parts.append(several.filter("n > 1").select("h", "c", (place - F.col("rep.high")).alias("u"), (place - F.col("rep.low")).alias("v")))
    rows = common.stage(_context_texts(docs, several.select("h", "c", "n", "rep")).dropDuplicates(["key", "d"]), "texts")
    while True:
        distinct = rows.groupBy("key", "d").agg(F.sum("n").alias("n"), F.max(F.length("text")).alias("size"))
        keys = distinct.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.sum("size").alias("size"))
        keys = common.stage(keys.filter("total > 1").select(F.col("key").alias("_key"), "m", "size"), "keys")
        met = rows.join(keys, F.col("key") == F.col("_key"))
        whole = met.filter("m = 1").select("h", "c", F.col("least").alias("u"), F.col("most").alias("v"))
        parts.append(whole)
        fit = keys.filter((F.col("m") > 1) & (F.col("size") <= INDEX_BYTES))
        size = fit.agg(F.sum("size")).collect()[0][0] or 0
        if size:
            fitting = met.filter((F.col("m") > 1) & (keys["size"] <= INDEX_BYTES)).select(rows.columns)
            found = common.stage(_indexed(fitting.dropDuplicates(["key", "d"]), size), "repeats")
            parts.append(
                rows.join(found.withColumnsRenamed({"key": "_k", "d": "_d"}), (F.col("key") == F.col("_k")) & (F.col("d") == F.col("_d"))).select("h", "c", "u", "v")
            )
        if keys.filter((F.col("m") > 1) & (F.col("size") > INDEX_BYTES)).isEmpty():
            break
        rest = met.filter((F.col("m") > 1) & (keys["size"] > INDEX_BYTES)).select(rows.columns)
        rows = common.stage(rest.mapInArrow(_refine, CONTEXT), "refined")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _hit(docs: DataFrame) -> DataFrame:
    """(_id, _hash, span): bytes of every text in windows that also start elsewhere."""
    table = anchor_table(docs)
    offsets = repeated_offsets(docs, table).withColumnsRenamed({"h": "_h", "c": "_c"})
    hit = table.join(offsets, (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c")))
    return hit.select(
        F.col("doc_id").alias("_id"),
        F.col("text_hash").alias("_hash"),
        F.struct((F.col("place") - F.col("v")).alias("s"), (F.col("place") - F.col("u") + MATCH).alias("e")).alias("span"),
    )


def shared_phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, h): anchors of passages that stand in different texts."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = phrases(*arrays.column_bytes(batch.column("text")))
            order = np.lexsort((found["h"], found["doc"]))
            doc, h = found["doc"][order], found["h"][order]
            once = np.ones(len(h), dtype=bool)
            once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            ids = [batch.column(c).take(pa.array(doc[once])) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(h[once])], names=["doc_id", "text_hash", "h"])

    table = common.stage(_rows(docs).mapInArrow(run, "doc_id bigint, text_hash bigint, h bigint"), "phrases")
    met = table.groupBy("h").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most"))
    met = met.filter("least < most").select(F.col("h").alias("_h"))
    return table.join(met, F.col("h") == F.col("_h")).select("doc_id", "text_hash", "h")


def _passage_words(kept: DataFrame) -> DataFrame:
    """(_hash, copies, covered) of every text of ``kept`` (text_hash, windows, starts): its
    rows, and its words in windows that also stand in another text."""
    # one row of each text: copies have equal windows
    texts = kept.groupBy("text_hash").agg(F.count("*").alias("copies"), F.first("windows").alias("windows"), F.first("starts").alias("starts"))
    texts = common.stage(texts, "passages")
    each = texts.select("text_hash", F.explode(F.array_distinct("windows")).alias("window"))
    met = each.groupBy("window").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most"))
    met = met.filter("least < most").select(F.col("window").alias("_window"))
    hit = each.join(met, F.col("window") == F.col("_window"))
    # the windows of one text meet in one row: as many as its own length allows
    hit = hit.groupBy(F.col("text_hash").alias("_hash")).agg(F.collect_list("window").alias("hit"))
    met = texts.join(hit, F.col("text_hash") == F.col("_hash"), "left").select("text_hash", "copies", "windows", "starts", "hit")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered = [0] * len(batch)
            for i, x in enumerate(zip(*(batch.column(c) for c in ("windows", "starts", "hit")), strict=True)):
                if x[2].is_valid:
                    windows, starts, hit = (y.values.to_numpy() for y in x)
                    at = np.sort(starts[np.isin(windows, hit)])
                    covered[i] = int(np.minimum(np.diff(at), PASSAGE).sum()) + PASSAGE
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), batch.column("copies"), pa.array(covered, pa.int64())], names=["_hash", "copies", "covered"])

    return met.mapInArrow(cover, "_hash bigint, copies bigint, covered bigint")


def _shared_windows(batch: pa.RecordBatch) -> list[pa.Array]:
    """Of every text, the hashes and first words of the windows whose anchor is one of its
    ``phrases``."""
    wanted = batch.column("phrases")
    rows = np.flatnonzero(wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    some = wanted.take(pa.array(rows))
    found = phrases(*arrays.column_bytes(batch.column("text").take(pa.array(rows))))

    def key(doc: np.ndarray, h: np.ndarray) -> np.ndarray:  # equal keys of different anchors only add windows
        return arrays.mix(doc.astype(_U) + _U(1)) ^ h.view(_U)

    asked = key(some.value_parent_indices().to_numpy(zero_copy_only=False), some.flatten().to_numpy(zero_copy_only=False))
    own = np.isin(key(found["doc"], found["h"]), asked)
    doc, low, high = (found[k][own] for k in ("doc", "low", "high"))
    at, doc = arrays.ranges(low, high - low + 1), np.repeat(doc, high - low + 1)
    ends = np.cumsum(np.bincount(rows[doc], minlength=len(wanted)))
    offsets = pa.array(np.append(0, ends).astype(np.int32))
    windows, starts = pa.array(found["windows"][at]), pa.array((at - found["first"][doc]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, windows), pa.ListArray.from_arrays(offsets, starts)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, ``spans`` (removed runs of
    bytes) and n_passage_words (words in PASSAGE words in a row that another document
    holds too, white space aside; these stay where no MATCH bytes repeat) of every whole
    text.

    Input: columns doc_id (integer) and text; others are ignored. Texts are UTF-8 bytes;
    null is empty; texts under MATCH bytes keep all. Repeated rows are documents of
    their own, so they repeat each other; rows of equal doc_id and text get one
    result each.
    """
    spark = docs.sparkSession
    hit = common.stage_alone(spark, lambda: _hit(docs), "spans")
    shared = common.stage_alone(spark, lambda: shared_phrases(docs), "shared-phrases").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "h": "phrase"})
    # the anchors of one document meet in one row: as many as its own length allows
    hit = hit.unionByName(shared, allowMissingColumns=True)
    hit = hit.groupBy("_id", "_hash").agg(F.collect_set("span").alias("spans"), F.collect_set("phrase").alias("phrases"))
    rows = _rows(docs)
    met = rows.join(hit, rows["doc_id"].eqNullSafe(hit["_id"]) & (rows["text_hash"] == hit["_hash"]), "left")
    met = met.select("doc_id", "text", "text_hash", "spans", "phrases")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text_hash", "n_words", "windows", "starts"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = arrays.column_bytes(batch.column("text"))
            removed, hashes, merged = [], [], []
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                text = data[at[k] : at[k + 1]]
                runs: list[dict] = []
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if runs and s <= runs[-1]["e"]:
                        runs[-1]["e"] = max(runs[-1]["e"], e)
                    else:
                        runs.append({"s": s, "e": e})
                sha, last = hashlib.sha256(), 0
                for r in runs:
                    sha.update(text[last : r["s"]])
                    last = r["e"]
                sha.update(text[last:])
                removed.append(sum(r["e"] - r["s"] for r in runs))
                hashes.append(sha.hexdigest())
                merged.append(runs)
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            longs = [pa.array(x, pa.int64()) for x in (np.diff(at), removed, [len(r) for r in merged])]
            values = [batch.column("doc_id"), *longs, pa.array(hashes, pa.string()), pa.array(merged, kind)]
            values += [batch.column("text_hash"), pa.array(word_counts(data, at), pa.int64()), *_shared_windows(batch)]
            yield pa.RecordBatch.from_arrays(values, names=names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<s:int,e:int>>"
    schema += ", text_hash bigint, n_words bigint, windows array<bigint>, starts array<int>"
    kept = common.stage_alone(spark, lambda: met.mapInArrow(cut, schema), "kept")
    found = common.stage_alone(spark, lambda: _passage_words(kept), "covered")
    counted = kept.join(found, F.col("text_hash") == F.col("_hash"))
    # a text in two rows stands in another document wholly
    words = F.when(F.col("copies") == 1, F.col("covered")).when(F.col("n_words") >= PASSAGE, F.col("n_words")).otherwise(0)
    return counted.select(*names[:6], words.cast("long").alias("n_passage_words"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.read(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
