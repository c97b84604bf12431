"""MinHash near-dedup: ProbMinHash signatures, banding, exact verification.

A document is its word 5-shingles weighted by their counts. Each shingle is a
Poisson process of its weight as rate: arrival times grow by exponential steps,
every arrival draws a register, and a register keeps the shingle that arrives
first. Two documents agree in a register with their probability Jaccard
similarity. Arrivals end early at the time by which all registers are sure to be
filled, so a long document costs one exponential a shingle and little more.

Bands of equal registers choose candidates. Documents that share a band are
joined by a link to the band's smallest id (a star, not pairs), and connected
components of these links are the candidate groups. Inside a group, components
of pairs with an exact probability Jaccard of 0.8 or more are searched breadth
first: a document is compared only with those not yet reached, so a group of
copies of one text is done in one pass. A group beyond ``GROUP_WORDS`` is cut into
blocks and every pair of blocks is one bounded task; exact for any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, common
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Registers, and rows of a band: a pair of similarity 0.8 shares no band with
#: probability (1 - 0.8^4)^32 < 1e-7.
REGISTERS, ROWS = 128, 4
#: Words of the documents that one task verifies together.
GROUP_WORDS = 400_000
#: Documents whose arrivals are held at once: some thousand for each register filled.
SLICE = 200
_U = arrays.U64


def shingles(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hash and count of every distinct shingle, by document. A
    document of fewer words, but not none, is one shingle."""
    counts = np.diff(offsets)
    each = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), each)
    first = arrays.ranges(offsets[:-1], each)
    value = np.zeros(len(first), _U)
    last = offsets[1:][doc]
    for k in range(SHINGLE):
        at = first + k
        inside = at < last
        word = np.where(inside, hashes[np.minimum(at, max(len(hashes) - 1, 0))], _U(0)) if len(hashes) else value
        value = arrays.mix(value + word) * _U(0x9E3779B97F4A7C15) + _U(k + 1)
    order, starts = arrays.grouped(arrays.mix(value + arrays.mix(doc.astype(_U))))
    pick = order[starts]
    weight = np.diff(np.append(starts, len(order)))
    by_doc = np.argsort(doc[pick], kind="stable")
    return doc[pick][by_doc], value[pick][by_doc], weight[by_doc].astype(np.float64)


def prob_minhash(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The ``m`` registers of each of ``n`` documents: per register the shingle that
    arrives first. Rows of documents without shingles are zero."""
    out = np.zeros((n, m), _U)
    total = np.bincount(doc, weight, n)
    todo, bound = np.flatnonzero(total > 0), m * (np.log(m) + 5.0)
    while len(todo):
        chosen = np.zeros(n, bool)
        chosen[todo] = True
        inside = chosen[doc]
        d, h, w = doc[inside], value[inside], weight[inside]
        end = (bound / total)[d]
        time = np.zeros(len(d))
        keys, times, owners = [], [], []
        step = 0
        while len(d):
            draw = arrays.mix(h + _U((2 * step + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))
            time = time - np.log1p(-((draw >> _U(11)).astype(np.float64) * 2.0**-53)) / w
            alive = time <= end
            d, h, w, end, time, draw = d[alive], h[alive], w[alive], end[alive], time[alive], draw[alive]
            register = arrays.mix(draw + _U(0x8CB92BA72F3D8DD7)) % _U(m)
            keys.append(d * m + register.astype(np.int64))
            times.append(time)
            owners.append(h)
            step += 1
        key, when, owner = np.concatenate(keys), np.concatenate(times), np.concatenate(owners)
        least = np.full(n * m, np.inf)
        np.minimum.at(least, key, when)
        won = when == least[key]
        flat = out.reshape(-1)
        flat[key[won]] = owner[won]
        todo = todo[np.isinf(least.reshape(n, m)[todo]).any(axis=1)]
        bound *= 2
    return out


def bands(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash a band of ``rows`` registers."""
    n, m = registers.shape
    out = np.zeros((n, m // rows), _U)
    for k in range(rows):
        out = arrays.mix(out * _U(0x9E3779B97F4A7C15) + registers[:, k::rows])
    return arrays.mix(out + np.arange(m // rows, dtype=_U))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the 128-bit hash (a, b) of the weighted shingles and the band
    hashes of every whole text; a text without words has null a, b and no bands."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty("text").alias("text"))
    names = ["doc_id", "n_words", "a", "b", "bands"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (batch.slice(k, SLICE) for batch in batches for k in range(0, batch.num_rows, SLICE))
        for batch in slices:
            n = batch.num_rows
            hashes, offsets = arrays.words(batch.column("text"))
            doc, value, weight = shingles(hashes, offsets)
            registers = prob_minhash(doc, value, weight, n)
            marked = arrays.mix(value * _U(0x9E3779B97F4A7C15) + weight.astype(_U))
            ab = np.zeros((2, n), _U)
            np.add.at(ab[0], doc, marked)
            np.add.at(ab[1], doc, arrays.mix(marked + _U(1)))
            words = np.diff(offsets)
            empty = words == 0
            hashed = bands(registers).view(np.int64)
            sizes = np.where(empty, 0, hashed.shape[1])
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(hashed[~empty].reshape(-1))
            )
            ids = [pa.array(x.view(np.int64), mask=empty) for x in ab]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), *ids, lists], names=names)

    schema = "doc_id bigint, n_words bigint, a bigint, b bigint, bands array<bigint>"
    return common.stage(rows.mapInArrow(sign, schema), "signatures")


def probability_jaccard(a: np.ndarray, b: np.ndarray, only_a: float, only_b: float) -> float:
    """Exact probability Jaccard of two documents from the weights of their shared
    shingles and the total weights of those that only one has."""
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    from_a = np.cumsum(a[::-1])[::-1]
    upto_b = np.cumsum(b) - b
    first = np.searchsorted(ratio, ratio, side="left")
    return float(np.sum(1.0 / ((from_a[first] + only_a) / a + (upto_b[first] + only_b) / b)))


def near_components(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """The first document of each document's component, where documents are linked by a
    probability Jaccard of ``similarity`` or more."""
    root = np.arange(n)
    total = np.bincount(doc, weight, n)
    _, vocabulary = np.unique(value, return_inverse=True)
    starts = np.searchsorted(doc, np.arange(n + 1))
    share, mine = weight / total[doc], np.zeros(int(vocabulary.max()) + 1 if len(vocabulary) else 0)
    left = np.flatnonzero(total > 0)
    while len(left):
        seed, left = left[0], left[1:]
        queue = [seed]
        while queue and len(left):
            i = queue.pop()
            own = slice(starts[i], starts[i + 1])
            mine[vocabulary[own]] = share[own]
            # the sum of smaller shares bounds the similarity from above
            sizes = starts[left + 1] - starts[left]
            at = arrays.ranges(starts[left], sizes)
            bound = np.add.reduceat(np.minimum(mine[vocabulary[at]], share[at]), np.cumsum(sizes) - sizes)
            reached = np.zeros(len(left), bool)
            for k in np.flatnonzero(bound >= similarity - 1e-9):
                other = slice(starts[left[k]], starts[left[k] + 1])
                both = mine[vocabulary[other]] > 0
                b = weight[other][both]
                a = mine[vocabulary[other]][both] * total[i]
                reached[k] = (
                    probability_jaccard(a, b, total[i] - a.sum(), total[left[k]] - b.sum()) >= similarity - 1e-9
                )
            mine[vocabulary[own]] = 0.0
            root[left[reached]] = seed
            queue.extend(left[reached])
            left = left[~reached]
    return root


def verified_links(nodes: DataFrame, texts: DataFrame, groups: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) that span the components of truly similar documents in each
    candidate group. ``nodes``: node, n_words; ``texts``: node, text; ``groups``: id, root."""
    member = groups.join(nodes, F.col("id") == F.col("node")).select("node", "root", "n_words")
    blocks = member.groupBy("root").agg(
        # two blocks meet in a task, so a block has half of its words
        F.when(F.sum("n_words") <= GROUP_WORDS, 1)
        .otherwise(F.ceil(2 * F.sum("n_words") / GROUP_WORDS))
        .cast("int")
        .alias("blocks")
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")),
            lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")),
        )
    )
    placed = member.join(blocks, "root").withColumn("own", own).withColumn("p", F.explode(pairs))
    rows = texts.join(placed, "node").select("node", "text", "root", "p.i", "p.j")

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        hashes, offsets = arrays.words(table.column("text"))
        root = near_components(*shingles(hashes, offsets), len(ids), similarity)
        linked = root != np.arange(len(ids))
        return pa.table({"u": ids[linked], "v": ids[root[linked]]})

    return common.stage(rows.groupBy("root", "i", "j").applyInArrow(verify, "u bigint, v bigint"), "near")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its near-duplicate class), n_words.

    Input: columns doc_id (integer) and text; others are ignored. Documents of equal
    weighted shingles are copies. A null, empty or wordless text is a class of its
    own. Rows of equal doc_id are taken for versions of one document and share its
    class; a row without doc_id takes the class of its copies, else null.
    """
    signed = signatures(docs)
    worded = signed.filter("a IS NOT NULL AND doc_id IS NOT NULL")
    copies = worded.groupBy("a", "b").agg(F.min("doc_id").alias("node"), F.first("n_words").alias("n_words"))
    copies = common.stage(copies, "copies")
    # one row a distinct text; its bands as stars around the smallest id of each band
    distinct = worded.join(copies.select("a", "b", "node"), ["a", "b"]).filter("doc_id = node").dropDuplicates(["a", "b"])
    banded = common.stage(distinct.select("node", F.explode("bands").alias("band")), "bands")
    stars = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    links = banded.join(stars.select("band", "hub"), "band").filter("node <> hub")
    groups = components(links.select(F.col("node").alias("u"), F.col("hub").alias("v")))
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), common.text_or_empty("text").alias("text"))
    nodes = copies.select("node", "n_words")
    # identical rows of one id would meet in a task: one of each text is enough
    wanted = rows.join(groups.select(F.col("id").alias("node")), "node", "left_semi")
    near = components(verified_links(nodes.groupBy("node").agg(F.sum("n_words").alias("n_words")), wanted, groups, similarity))
    roots = copies.join(near, copies["node"] == near["id"], "left").select(
        "a", "b", F.coalesce("root", "node").alias("class_id")
    )
    found = signed.join(roots, ["a", "b"], "left")
    return found.select(
        "doc_id", F.when(F.col("a").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_words"
    )


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents", ["doc_id", "text"]))


def first_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the smallest doc_id of each class. Texts without
    words have no shingles to compare; those that are equal but for white space are copies,
    so of the copies that line dedup emptied one row stays. Repeated rows of one doc_id are
    reduced to one; documents without id stay."""
    found = common.stage(near_duplicates(docs), "classes")
    later = found.filter("class_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct()
    wordless = found.filter("n_words = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    seen = F.regexp_replace(common.text_or_empty("text"), r"[\x20\x09-\x0D]", "")
    bare = docs.select(F.col("doc_id").cast("long").alias("_id"), F.md5(F.encode(seen, "UTF-8")).alias("_seen")).join(wordless, "_id")
    first = bare.groupBy("_seen").agg(F.min("_id").alias("_first"))
    # an id may stand for several texts: it goes only if none of them comes first
    repeats = bare.join(first, "_seen").groupBy("_id").agg(F.min(F.col("_id") - F.col("_first")).alias("_d")).filter("_d > 0").select("_id")
    repeats = repeats.join(found.filter("n_words > 0").select(F.col("doc_id").alias("_id")), "_id", "left_anti")
    gone = later.union(repeats)
    kept = docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    if found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    known = kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return known.unionByName(kept.filter("doc_id IS NULL"))
