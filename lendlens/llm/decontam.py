"""Benchmark decontamination: a positional inverted index distributed by documents.

Building stores, for each block of documents, the postings of all its tokens:
sorted term hashes and, for each, the ascending token positions, in a Parquet
table under the shared folder. A block's documents lie one after the other on
one position axis, with a gap that no phrase bridges. Searching takes the test
items to every block: a phrase starts from its rarest term's list, and the other
lists, adjusted by their offset in the phrase, are intersected with it from rare
to frequent. Nothing is shuffled: blocks are independent, so a passage in a third
of all documents only lengthens the lists of each block by its own share.

Test items are taken in blocks of at most :data:`BLOCK_WORDS` words, which bounds
what a task holds of them whatever the benchmark's size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common

#: Words of a phrase; a document word inside any of its occurrences is hit.
PHRASE = 13
#: Words of test items searched in one pass over the index: 8 bytes each and a list entry.
BLOCK_WORDS = 500_000
#: Proximity: the item's rarest terms (by documents of the whole index that hold them,
#: equal ones in the item's order; terms that no document holds are passed over), all
#: within so many words of the rarest one. An item with fewer such terms is near nothing,
#: unless it has no more distinct words.
NEAR_TERMS, NEAR_SPAN = 4, 26



def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text; a null text is empty): a row a block with
    its doc_ids, text hashes and, as little-endian arrays, document starts and
    word counts, sorted terms, list offsets and positions."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty("text").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    schema = (
        "doc_ids array<bigint>, text_hashes array<bigint>, starts binary, counts binary, terms binary, lists binary, positions binary"
    )

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_ids", "text_hashes", "starts", "counts", "terms", "lists", "positions"]
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, offsets = arrays.words(batch.column("text"))
            counts = np.diff(offsets)
            starts = offsets[:-1] + PHRASE * np.arange(len(counts))  # a gap that no phrase bridges
            where = np.arange(len(hashes), dtype=np.int64) + np.repeat(starts - offsets[:-1], counts)
            order, first = arrays.grouped(hashes)
            row = [
                batch.column("doc_id").to_pylist(),
                batch.column("text_hash").to_pylist(),
                starts.astype("<u4").tobytes(),
                counts.astype("<u4").tobytes(),
                hashes[order[first]].astype("<u8").tobytes(),
                np.append(first, len(hashes)).astype("<u4").tobytes(),
                where[order].astype("<u4").tobytes(),
            ]
            kinds = [pa.list_(pa.int64())] * 2 + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    return common.stage(rows.mapInArrow(post, schema), "postings")


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """The test items (id as text, word hashes) in blocks of bounded size. Items
    without words are left out; rows of equal item_id are separate phrases of one item,
    and so are rows without an id."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = arrays.words(batch.column("text"))
            parts = [hashes[a:b].astype("<u8").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(parts, pa.binary())], names=["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), common.text_or_empty("text").alias("text"))
    rows = rows.mapInArrow(hashed, "item_id string, words binary")
    block, size = [], 0
    for row in rows.filter("length(words) > 0").toLocalIterator():
        block.append((row["item_id"], np.frombuffer(row["words"], "<u8")))
        size += len(row["words"]) // 8
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def near_terms(index: DataFrame, block: list[tuple[str, np.ndarray]]) -> list[np.ndarray]:
    """For every item of a block its NEAR_TERMS rarest terms, rarest first, by the documents
    that hold them, summed over all blocks of the index; empty if there are too few."""
    terms = np.unique(np.concatenate([words for _, words in block])) if block else np.zeros(0, np.uint64)
    packed = index.sparkSession.sparkContext.broadcast(terms.tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = np.frombuffer(packed.value, np.uint64)
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("starts", "<u4"), ("terms", "<u8"), ("lists", "<u4"), ("positions", "<u4"))}
                lists = _Lists(row["terms"], row["lists"], row["positions"])
                at, length = lists.find(terms)
                held = np.flatnonzero(length)
                place = lists.lists[at[held]]
                where = lists.positions[arrays.ranges(place, length[held])]
                doc = np.searchsorted(row["starts"], where, side="right")
                owner = np.repeat(held, length[held])
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])  # positions ascend, so do documents
                total += np.bincount(owner[new], minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "docs"])

    found = np.zeros(len(terms), np.int64)
    if len(terms):
        parts = index.select("starts", "terms", "lists", "positions").mapInArrow(count, "term bigint, docs bigint")
        table = parts.groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()  # at most a row a term of the block
        found[table["term"].to_numpy()] = table["docs"].to_numpy()
    out = []
    for _, words in block:
        words = words[np.sort(np.unique(words, return_index=True)[1])]
        docs = found[np.searchsorted(terms, words)]
        known = np.flatnonzero(docs)
        rare = known[np.argsort(docs[known], kind="stable")][:NEAR_TERMS]
        out.append(words[rare] if len(rare) == min(NEAR_TERMS, len(words)) else words[:0])
    return out


class _Lists:
    """The posting lists of one block of documents."""

    def __init__(self, terms: np.ndarray, lists: np.ndarray, positions: np.ndarray):
        self.terms, self.lists, self.positions = terms, lists.astype(np.int64), positions

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of each word's list; length 0 where there is none."""
        at = np.searchsorted(self.terms, words)
        if not len(self.terms):  # a block of texts without words
            return at, np.zeros(len(words), np.int64)
        at[at == len(self.terms)] = 0
        return at, np.where(self.terms[at] == words, self.lists[at + 1] - self.lists[at], 0)

    def get(self, at: int) -> np.ndarray:
        return self.positions[self.lists[at] : self.lists[at + 1]]


def _starts(lists: _Lists, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions at which the phrase begins: offset-adjusted lists from the rarest term on."""
    order = np.argsort(length, kind="stable")
    found = lists.get(at[order[0]]).astype(np.int64) - order[0]
    for k in order[1:]:
        if not len(found):
            break
        other = lists.get(at[k])
        place = np.searchsorted(other, found + k)
        place[place == len(other)] = 0
        found = found[other[place] == found + k]
    return found


def _near(lists: _Lists, terms: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Documents in which the terms all lie within NEAR_SPAN words of the first one."""
    at, length = lists.find(terms)
    if not len(terms) or not length.all():
        return np.zeros(0, np.int64)
    found = lists.get(at[0]).astype(np.int64)
    doc = np.searchsorted(starts, found, side="right") - 1
    low = np.maximum(found - NEAR_SPAN, starts[doc])
    high = np.minimum(found + NEAR_SPAN, starts[doc] + counts[doc] - 1)
    for k in at[1:]:
        other = lists.get(k)
        held = np.searchsorted(other, low) < np.searchsorted(other, high, side="right")
        doc, low, high = doc[held], low[held], high[held]
    return np.unique(doc)


def _search_block(row: dict, items: list[tuple[str, np.ndarray]], rare: list[np.ndarray] | None) -> tuple[list, list, list]:
    """For every document of an index block: merged hit spans, items found, items near."""
    lists = _Lists(*(np.frombuffer(row[k], t) for k, t in (("terms", "<u8"), ("lists", "<u4"), ("positions", "<u4"))))
    starts, counts = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("starts", "counts"))
    n = len(starts)
    begins, ends, found_items, near = [], [], [set() for _ in range(n)], [set() for _ in range(n)]
    for k, (item, words) in enumerate(items):
        at, length = lists.find(words)
        size = min(PHRASE, len(words))
        present = np.concatenate([[0], np.cumsum(length > 0)])
        for i in np.flatnonzero(present[size:] - present[:-size] == size):
            found = _starts(lists, at[i : i + size], length[i : i + size])
            if len(found):
                begins.append(found)
                ends.append(found + size)
                for d in np.unique(np.searchsorted(starts, found, side="right") - 1):
                    found_items[d].add(item)
        for d in _near(lists, rare[k], starts, counts) if rare is not None and item is not None else ():
            near[d].add(item)
    spans: list[list[dict]] = [[] for _ in range(n)]
    if begins:
        b, e = np.concatenate(begins), np.concatenate(ends)
        order = np.argsort(b, kind="stable")
        b, e = b[order], np.maximum.accumulate(e[order])
        new = np.flatnonzero(np.concatenate([[True], b[1:] > e[:-1]]))
        last = np.append(new[1:], len(b)) - 1
        for x, y in zip(b[new], e[last], strict=True):
            d = int(np.searchsorted(starts, x, side="right") - 1)
            spans[d].append({"start": int(x - starts[d]), "end": int(y - starts[d])})
    ids = lambda x: sorted(x - {None}) + [None] * (None in x)
    return spans, [ids(x) for x in found_items], [ids(x) for x in near]


SPANS = "array<struct<start:bigint,end:bigint>>"


def search(index: DataFrame, benchmark: DataFrame, proximity: bool = True) -> DataFrame:
    """A row for each indexed document: doc_id, text_hash, n_words, ``hits`` (merged
    spans of hit words), ``items`` (ids with an occurring phrase, last a null for
    items without an id) and ``near`` (ids, nulls left out,
    whose rarest words all meet within NEAR_SPAN words, in any order; empty without
    ``proximity``, which counts the items' terms over the whole index first)."""
    parts = []
    schema = f"doc_id bigint, text_hash bigint, n_words bigint, hits {SPANS}, items array<string>, near array<string>"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["doc_id", "text_hash", "n_words", "hits", "items", "near"]
    for block in [*item_blocks(benchmark)] or [[]]:
        packed = index.sparkSession.sparkContext.broadcast(pickle.dumps((block, near_terms(index, block) if proximity else None)))

        def look(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            items, rare = pickle.loads(packed.value)
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                    spans, found, near = _search_block(row, items, rare)
                    values = [row["doc_ids"], row["text_hashes"], counts, spans, found, near]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=names
                    )

        parts.append(index.mapInArrow(look, schema))
    if len(parts) == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    # one row a document and block of test items: as many rows meet as there are such blocks
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    met = whole.groupBy("doc_id", "text_hash", "n_words").agg(
        union("hits"), union("items"), union("near"), (F.count("*") / len(parts)).cast("int").alias("_rows")
    )
    # a repeated row is given as often as it was there
    return met.withColumn("hits", _merged("hits")).withColumn("_rows", F.explode(F.sequence(F.lit(1), "_rows"))).drop("_rows")


def _merged(name: str):
    """Sorted spans with those that overlap or touch made one."""
    return F.expr(
        f"""aggregate({name}, cast(array() as {SPANS}), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).end >= x.start,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
           concat(a, array(x))))"""
    )


def judge(docs: DataFrame, benchmark: DataFrame, proximity: bool = True) -> DataFrame:
    """:func:`search` over a fresh index, with ``n_hit``, ``n_items`` and
    ``contaminated`` (n_hit > 0 and 20 * n_hit >= n_words).

    A null or empty text has no words; items without an item_id hit words and count as
    one item, which has no id to list; an item without words is left out; an empty
    benchmark hits nothing; rows of equal doc_id and text each give a row.
    """
    found = search(build_index(docs), benchmark, proximity)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", ["doc_id", "text"])
    found = judge(docs, common.read(spark, sf_dir, "benchmark", ["item_id", "text"]), proximity=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items near each document: their number and a hash of their ids."""
    docs = common.read(spark, sf_dir, "documents", ["doc_id", "text"])
    found = search(build_index(docs), common.read(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return found.select(
        "doc_id",
        F.size("near").cast("long").alias("n_near"),
        F.sha2(F.array_join("near", ","), 256).alias("near_sha256"),
    )


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), {PHRASE}) AS size, list_slice(w, i, i + least(len(w), {PHRASE}) - 1) AS p
  FROM b, unnest(generate_series(1, greatest(len(w) - {PHRASE - 1}, 1))) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM phrases),
found AS (
  SELECT DISTINCT d.doc_id, x.i, x.size, p.item_id
  FROM (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS p
        FROM d, sizes, unnest(generate_series(1, len(w) - size + 1)) AS u(i)) x
  JOIN phrases p ON p.size = x.size AND p.p = x.p JOIN d ON d.doc_id = x.doc_id
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(generate_series(i, i + size - 1)) AS u(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP10_NEAR_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
own AS (SELECT r, w[i] AS t, min(i) AS i FROM b, unnest(generate_series(1, len(w))) AS u(i) GROUP BY r, w[i]),
places AS (
  SELECT doc_id, i, t FROM (SELECT doc_id, i, w[i] AS t FROM d, unnest(generate_series(1, len(w))) AS u(i))
  WHERE t IN (SELECT t FROM own)
), df AS (SELECT t, count(DISTINCT doc_id) AS n FROM places GROUP BY t),
sizes AS (SELECT r, least({NEAR_TERMS}, count(*)) AS size FROM own GROUP BY r),
ranked AS (SELECT r, t, row_number() OVER (PARTITION BY r ORDER BY n, i) AS k FROM own JOIN df USING (t)),
terms AS (SELECT r, t, k, size FROM ranked JOIN sizes USING (r) WHERE k <= {NEAR_TERMS}),
met AS (
  SELECT p.doc_id, p.i, a.r, any_value(a.size) AS size, count(DISTINCT z.k) AS n
  FROM terms a JOIN places p ON p.t = a.t JOIN terms z ON z.r = a.r
  JOIN places q ON q.t = z.t AND q.doc_id = p.doc_id AND abs(q.i - p.i) <= {NEAR_SPAN}
  WHERE a.k = 1 GROUP BY p.doc_id, p.i, a.r
), near AS (
  SELECT doc_id, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM met JOIN b USING (r) WHERE n = size) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_near, 0) AS n_near, sha256(coalesce(ids, '')) AS near_sha256 FROM d LEFT JOIN near USING (doc_id)
"""


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not contaminated, unchanged."""
    bad = judge(docs, common.read(spark, sf_dir, "benchmark", ["item_id", "text"]), proximity=False).filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(common.text_or_empty("text")) == bad["_hash"])
    return docs.join(bad, same, "left_anti")
