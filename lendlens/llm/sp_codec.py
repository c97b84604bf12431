"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is its characters, with a sign for each space and one more in front. An
agenda holds the adjacent symbol pairs that form a piece; the pair with the best
score, leftmost among equals, is merged, and the pairs beside it are renewed,
until none is left. :func:`agenda` does so for one word with a heap. No piece
goes on after a space sign that ends a word, so the words of a text merge apart
from each other; :func:`merge_all` therefore runs the same agenda for all
distinct words of an Arrow batch at once, one merge a word and round.

Encoding and decoding are one pass over the texts, without shuffle; memory is that
of one batch. All distinct words of each batch, and every ``check_every``-th document
(by hash) as a whole, are held against the sentencepiece library; a difference stops the job.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common

SPACE = "▁"
#: Words of more symbols go through the heap, one at a time.
WIDE = 32
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """The pieces of a sentencepiece BPE model: ids of single characters, and a hash
    table from pairs of ids to the merged id. Raises for models of another kind."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece goes on after a space: words do not merge apart")
        if lib.encode("a  b") != lib.encode("a" + SPACE * 2 + "b") or lib.decode(lib.encode(" a ")) != " a ":
            raise ValueError("the model normalises its text")
        self.byte = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        if not all(lib.is_byte(int(i)) for i in self.byte):
            raise ValueError("the model has no byte pieces")
        self.n, self.names = n, [str(i) for i in range(n)]
        self.bytes = [b"" if lib.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for b in range(256):
            self.bytes[int(self.byte[b])] = bytes([b])
        for i in range(n):
            if lib.is_unknown(i):
                self.bytes[i] = lib.decode([i]).encode()
        # symbols: a piece's id; an unknown character of one byte is that byte's piece, others are -code point
        self.symbol = -np.arange(0x110000, dtype=np.int32)
        self.symbol[:128] = self.byte[:128]
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[32] = self.symbol[ord(SPACE)]
        # a pair's rank is its piece's place by score; equal scores share a rank
        scores = sorted({lib.get_score(i) for p, i in ids.items() if len(p) > 1}, reverse=True)
        place = {score: rank for rank, score in enumerate(scores)}
        self.pairs: dict[int, tuple[int, int]] = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    self.pairs[ids[p[:k]] << 32 | ids[p[k:]]] = (place[lib.get_score(i)], i)
        todo = np.array(list(self.pairs), np.int64)
        value = np.array(list(self.pairs.values()), np.int32).reshape(-1, 2)
        self.bits = max(4, int(len(todo) * 4).bit_length())
        self.table, self.merges = np.full(1 << self.bits, -1, np.int64), np.full((1 << self.bits, 2), _NONE, np.int32)
        slot = self._slot(todo)
        while len(todo):  # linear probing, all keys at once
            free = self.table[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.table[slot[put]], self.merges[slot[put]] = todo[put], value[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, value, slot = todo[rest], value[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(arrays.U64) * arrays.U64(0x9E3779B97F4A7C15)) >> arrays.U64(64 - self.bits)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray, what: int = 0) -> np.ndarray:
        """The rank (``what`` 0) or the piece (1) of each pair's merge; the largest number
        where the pair forms no piece."""
        out = np.full(len(left), _NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[at].astype(np.int64) << 32 | right[at]
        slot = self._slot(key)
        while len(at):
            held = self.table[slot]
            same = held == key
            out[at[same]] = self.merges[slot[same], what]
            on = ~same & (held >= 0)
            at, key, slot = at[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


def agenda(symbols: list[int], vocabulary: Vocabulary) -> list[int]:
    """Merge one word: a heap of adjacent pairs by rank, then from left to right."""
    symbols, n = list(symbols), len(symbols)
    before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n

    def offer(i: int, j: int) -> None:
        if 0 <= i and j < n and symbols[i] >= 0 and symbols[j] >= 0:
            found = vocabulary.pairs.get(symbols[i] << 32 | symbols[j])
            if found is not None:
                heapq.heappush(heap, (found[0], i, j, symbols[i], symbols[j], found[1]))

    heap: list[tuple] = []
    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, left, right, piece = heapq.heappop(heap)
        if gone[i] or gone[j] or symbols[i] != left or symbols[j] != right or after[i] != j:
            continue
        symbols[i], gone[j], after[i] = piece, True, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [s for s, g in zip(symbols, gone, strict=True) if not g]


def merge_all(symbols: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge many words: the agenda's order for each, one merge a word and round."""
    sizes = np.diff(offsets)
    out_sizes = sizes.copy()
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, sizes, symbols
    ones = np.flatnonzero(sizes <= 1)
    done.append((ones, sizes[ones], symbols[arrays.ranges(offsets[ones], sizes[ones])]))
    low = 1
    for width in (4, 8, 12, 16, 24, WIDE):
        row = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        if not len(row):
            continue
        column = np.arange(width)
        inside = column < sizes[row][:, None]
        grid = np.full((len(row), width), -(2**30), np.int32)
        grid[inside] = symbols[arrays.ranges(offsets[row], sizes[row])]
        rank = np.full((len(row), width), _NONE, np.int32)
        rank[:, :-1] = vocabulary.merge(grid[:, :-1].reshape(-1), grid[:, 1:].reshape(-1)).reshape(len(row), -1)
        size = sizes[row].copy()
        while len(row):
            at = rank.argmin(axis=1)
            line = np.arange(len(row))
            best = rank[line, at]
            over = best == _NONE
            if over.any():
                kept = grid[over]
                n = size[over]
                done.append((row[over], n, kept[column < n[:, None]]))
                on = ~over
                row, grid, rank, size, at = row[on], grid[on], rank[on], size[on], at[on]
                line = np.arange(len(row))
                if not len(row):
                    break
            grid[line, at] = vocabulary.merge(grid[line, at], grid[line, at + 1], 1)
            move = np.minimum(column + (column > at[:, None]), width - 1)
            grid = np.take_along_axis(grid, move, 1)
            rank = np.take_along_axis(rank, np.minimum(column + (column >= at[:, None]), width - 1), 1)
            size -= 1
            grid[line, size] = -(2**30)
            rank[line, np.maximum(size - 1, 0)] = _NONE
            left = at > 0
            rank[line[left], at[left] - 1] = vocabulary.merge(grid[line[left], at[left] - 1], grid[line[left], at[left]])
            right = at + 1 < size
            rank[line[right], at[right]] = vocabulary.merge(grid[line[right], at[right]], grid[line[right], at[right] + 1])
    for w in np.flatnonzero(sizes > WIDE):
        merged = np.array(agenda(symbols[offsets[w] : offsets[w + 1]].tolist(), vocabulary), np.int32)
        done.append((np.array([w]), np.array([len(merged)]), merged))
    for w, n, _ in done:
        out_sizes[w] = n
    ends = np.cumsum(out_sizes)
    result = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for w, n, s in done:
        result[arrays.ranges((ends - out_sizes)[w], n)] = s
    return result, np.append(0, ends)


def encode_batch(column: pa.Array, vocabulary: Vocabulary, verify: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of every text, one text after the other, and the texts' offsets.

    ``verify`` holds the ids of every distinct word against the library."""
    data, offsets = arrays.column_bytes(column)
    sign = SPACE.encode()
    if (data == sign[0]).any() and sign in (whole := data.tobytes()):  # a space sign in the text counts as a space
        parts = [whole[a:b].replace(sign, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts]))
    n = len(offsets) - 1
    worded = np.flatnonzero(np.diff(offsets) > 0)
    data = np.insert(data, offsets[worded], 32)
    offsets = offsets + np.searchsorted(worded, np.arange(n + 1))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    space, line = data == 32, data == 10
    start = line.copy()
    start[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))
    order, first = arrays.grouped(arrays.span_hashes(data, starts, ends))
    pick = order[first]
    kind = np.empty(len(starts), np.int64)
    kind[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    # the distinct words as symbols
    sizes = (ends - starts)[pick]
    raw = data[arrays.ranges(starts[pick], sizes)]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    word = leads[np.append(0, np.cumsum(sizes))]
    merged, at = merge_all(vocabulary.symbol[points], word, vocabulary)
    merged = merged.astype(np.int64)
    wide = np.flatnonzero(merged < 0)
    if len(wide):  # unknown characters: their bytes
        size = np.ones(len(merged), np.int64)
        encoded = [chr(-int(x)).encode() for x in merged[wide]]
        size[wide] = [len(x) for x in encoded]
        to = np.append(0, np.cumsum(size))
        longer = np.empty(int(to[-1]), np.int64)
        known = merged >= 0
        longer[to[:-1][known]] = merged[known]
        longer[arrays.ranges(to[:-1][wide], size[wide])] = vocabulary.byte[np.frombuffer(b"".join(encoded), np.uint8)]
        merged, at = longer, to[at]
    if verify:
        _check_words(raw, np.append(0, np.cumsum(sizes)), merged, at, vocabulary)
    tokens = np.diff(at)[kind]
    ids = merged[arrays.ranges(at[:-1][kind], tokens)]
    upto = np.append(0, np.cumsum(tokens))
    return ids, upto[np.searchsorted(starts, offsets)]


def _check_words(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> None:
    """Words (bytes and ids) against the library, which takes them as one text with a
    line a word: a new line starts a word, as it does in :func:`encode_batch`."""
    text = np.insert(raw, offsets[:-1], 10).tobytes().decode()
    lead, two = (encode_batch(pa.array([t]), vocabulary)[0] for t in ("\n", "\n\n"))
    line = two[len(lead) :]
    between = np.repeat(at[1:-1], len(line))
    own = np.concatenate([lead, np.insert(ids, between, np.tile(line, len(at) - 2))]).tolist()
    if own != vocabulary.library.encode(text, num_threads=1) or decode(own, vocabulary) != vocabulary.library.decode(own):
        raise ValueError("ids or text differ from the sentencepiece library's")


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of a list of ids: pieces with space signs as spaces, byte pieces as
    UTF-8 (a byte that is none gives U+FFFD), without the space put in front."""
    raw = b"".join(map(vocabulary.bytes.__getitem__, ids))
    if raw[:1] == b" ":
        raw = raw[1:]
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return vocabulary.library.decode(ids)


_loaded: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """The vocabulary, loaded once a Python worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str, check_every: int = 64) -> DataFrame:
    """doc_id, ``ids`` and ``decoded`` of every whole text; see :func:`digests`."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model)
        for batch in batches:
            ids, at = checked(batch.column("text"), vocabulary, check_every)
            texts = [decode(ids[a:b].tolist(), vocabulary) for a, b in zip(at[:-1], at[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts)], names=["doc_id", "ids", "decoded"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def checked(column: pa.Array, vocabulary: Vocabulary, check_every: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`encode_batch` with all distinct words held against the library, and every
    ``check_every``-th whole text (by its checksum) as well; 0 checks nothing."""
    ids, at = encode_batch(column, vocabulary, verify=check_every > 0)
    for k in range(len(column)) if check_every else ():
        text = column[k].as_py()
        if zlib.crc32(text.encode()) % check_every == 0:
            own = ids[at[k] : at[k + 1]].tolist()
            if own != vocabulary.library.encode(text, num_threads=1) or decode(own, vocabulary) != vocabulary.library.decode(own):
                raise ValueError("ids or text differ from the sentencepiece library's")
    return ids, at


def digests(docs: DataFrame, model: str, check_every: int = 64) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    Input: columns doc_id (integer) and text; others are ignored. A null text is
    empty and has no ids; repeated rows give repeated results.
    """
    common.small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model)
        for batch in batches:
            ids, at = checked(batch.column("text"), vocabulary, check_every)
            hashes, decoded = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = ids[a:b].tolist()
                hashes.append(hashlib.sha256(",".join(map(vocabulary.names.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(decode(own, vocabulary).encode()).hexdigest())
            values = [batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(values, names=names)

    return _rows(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty("text").alias("text"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents", ["doc_id", "text"]), default_model())


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the token ids and digests of every document."""
    return digests(docs, default_model())
