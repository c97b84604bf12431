"""K-means model over embeddings (M6) and nearest-neighbour search with an
inverted-file (IVF) coarse quantiser (M5).

The audited script creates a standardised K-means model and two IVF cosine
indexes. Spark has no persistent vector index; the index becomes a join plan:

1. a K-means coarse quantiser (``nlist`` centres, ``pyspark.ml``) is trained
   on the unit-normalised base vectors; every base row gets its cell;
2. base rows lie in pieces of neighbouring cells and queries in blocks, both of
   bounded size. Each query row computes its distance to the ``nlist`` centres
   (the centre matrix is bounded by the ``nlist`` parameter), and goes to the
   pieces that hold its ``nprobe`` nearest cells; a task takes one block and one
   piece, and hands on the k nearest rows of every query, not its pairs;
3. ``exact=True`` adds a second round that makes the result exact: a cell
   whose lower bound ``|q - c| - radius(c)`` is below the query's current
   k-th distance may still hold a closer row, so all of those cells are
   searched and the top-k is taken from them. Nothing is capped.

Distances are cosine (``1 - cos``); on unit vectors the Euclidean distance is
monotone in it, which is what the bounds use.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dlit
from ..functions.vectors import normalize
from ..sources.sinks import scratch_table
from .kmeans import kmeans


def kmeans_model(df: DataFrame, vector_col: str, k: int = 50, seed: int = 42, standardize: bool = True,
                 max_iter: int = 20, prediction_col: str = "kmeans_cluster"):
    """M6: ``array_to_vector -> StandardScaler(mean, std) -> KMeans(k)``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler

    features = "_scaled" if standardize else "_features"
    stages = []
    if standardize:
        stages.append(StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True))
    stages.append(KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=features, predictionCol=prediction_col))
    return Pipeline(stages=stages).fit(_as_features(df, vector_col))


def _as_features(df: DataFrame, vector_col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.where(F.col(vector_col).isNotNull()).withColumn("_features", array_to_vector(F.col(vector_col)))


def kmeans_assign(df: DataFrame, vector_col: str, id_col: str, k: int = 50, standardize: bool = True) -> DataFrame:
    """``(id, kmeans_cluster)`` per row by the fixed steps of :mod:`kmeans`, the same on every run."""
    return kmeans(df, id_col, vector_col, k, standardize=standardize)


def ivf_index(base: DataFrame, id_col: str, vector_col: str, nlist: int = 64, seed: int = 42):
    """Train the coarse quantiser and assign every base row to a cell.

    Returns ``(cells, centres, radii)``: ``cells`` is the base table with
    ``_unit`` (normalised vector) and ``_cell``; ``centres`` the ``nlist``
    centre vectors (a driver-side list bounded by ``nlist``); ``radii`` a
    ``nlist``-row DataFrame ``(_cell, _radius)``.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = base.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).alias("_bid"), normalize(F.col(vector_col)).alias("_unit")
    )
    model = KMeans(k=nlist, seed=seed, featuresCol="_f", predictionCol="_cell").fit(
        unit.withColumn("_f", array_to_vector("_unit"))
    )
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    cells = model.transform(unit.withColumn("_f", array_to_vector("_unit"))).drop("_f")
    # nlist rows of dim numbers: size bounded by the parameters, so broadcast
    centre_rows = base.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(centres)], "_cell int, _centre array<double>"
    )
    radii = (
        cells.join(F.broadcast(centre_rows), "_cell")
        .groupBy("_cell")
        .agg(F.max(F.sqrt(F.aggregate(F.zip_with("_unit", "_centre", lambda a, b: (a - b) * (a - b)), dlit(0.0),
                                      lambda acc, x: acc + x))).alias("_radius"))
    )
    return cells, centres, radii


#: Queries on which the probes of a recall goal are measured: bounds the driver and the brute-force work.
RECALL_SAMPLE = 400


def probes_for_recall(queries: DataFrame, cells: DataFrame, centres: list[list[float]], recall: float, k: int,
                      exclude_self: bool) -> int:
    """The fewest cells to probe so that the mean share of true neighbours found, less two
    standard errors, reaches ``recall`` on the sample: the RECALL_SAMPLE query rows
    ``(_qid, _qunit)`` of smallest id hash, searched by brute force (linear in the base;
    a partition hands on k rows a sampled query). Without true neighbours: one."""
    sample = queries.where(F.col("_qid").isNotNull()).orderBy(F.xxhash64("_qid"), "_qid").limit(RECALL_SAMPLE).collect()
    if not sample or not centres:
        return 1
    ids, q = [r["_qid"] for r in sample], np.array([r["_qunit"] for r in sample], dtype=float)
    places: dict = {}
    for i, own in enumerate(ids):
        places.setdefault(own, []).append(i)

    def nearest(batches):
        row, dist, cell = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            with np.errstate(invalid="ignore", over="ignore"):
                d = 1.0 - q @ _matrix(pa.chunked_array([batch["_unit"]])).T
            if exclude_self:
                mine = pc.index_in(batch["_bid"], pa.array(list(places)).cast(batch["_bid"].type))
                for j in np.flatnonzero(mine.is_valid().to_numpy(zero_copy_only=False)):
                    d[list(places.values())[mine[int(j)].as_py()], j] = np.inf
            d[~np.isfinite(d)] = np.inf
            limit = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(ids), np.inf)
            a, b = np.nonzero((d <= limit[:, None]) & (d < np.inf))
            row, dist = np.append(row, a), np.append(dist, d[a, b])
            cell = np.append(cell, batch["_cell"].to_numpy()[b])
            order = np.lexsort((dist, row))  # stable: of equal distances the earlier
            row, dist, cell = row[order], dist[order], cell[order]
            first = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
            row, dist, cell = row[first], dist[first], cell[first]
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(dist), pa.array(cell, pa.int32())], names=["q", "d", "_cell"])

    w = Window.partitionBy("q").orderBy("d", "_cell")
    found = cells.select("_bid", "_unit", "_cell").mapInArrow(nearest, "q long, d double, _cell int")
    found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("q", "_cell").collect()
    if not found:
        return 1
    c = np.array(centres, dtype=float)
    order = np.argsort((c * c).sum(axis=1)[None, :] - 2.0 * q @ c.T, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    hit, total = np.zeros((len(ids), len(centres))), np.zeros(len(ids))
    for r in found:
        hit[r["q"], rank[r["q"], r["_cell"]]] += 1
        total[r["q"]] += 1
    share = np.cumsum(hit[total > 0], axis=1) / total[total > 0][:, None]
    low = share.mean(axis=0) - 2.0 * share.std(axis=0) / math.sqrt(len(share))
    return int(np.argmax(low >= min(recall, 1.0) - 1e-12)) + 1


def knn_join(queries: DataFrame, base: DataFrame, *, query_id: str, base_id: str, vector_col: str, k: int = 10,
             nlist: int | None = None, nprobe: int | None = 4, exact: bool = True, exclude_self: bool = True,
             seed: int = 42, recall: float | None = None) -> DataFrame:
    """M5: the ``k`` nearest base rows (cosine) of every query row.

    Returns ``(query_id, neighbour_id, cosine_distance, neighbour_rank)``.
    ``exact=True`` guarantees the same result as a brute-force search;
    ``exact=False`` is the approximate IVF search over ``nprobe`` cells (``None``:
    all of them, which finds the same as brute force). ``nlist=None`` takes the
    square root of the base rows, so a cell grows no faster than the cell count.
    ``recall`` replaces ``nprobe`` by the cells that reach it (:func:`probes_for_recall`).
    """
    if nlist is None:
        nlist = max(1, math.isqrt(base.count()))
    nprobe = nlist if nprobe is None else nprobe
    cells, centres, radii = ivf_index(base, base_id, vector_col, nlist, seed)
    q = queries.where(F.col(vector_col).isNotNull()).select(
        F.col(query_id).alias("_qid"), normalize(F.col(vector_col)).alias("_qunit")
    )
    if recall is not None:
        nprobe = probes_for_recall(q, cells, centres, recall, k, exclude_self)
    if exclude_self:  # an unknown id is neither another row's nor its own
        q, cells = q.where(F.col("_qid").isNotNull()), cells.where(F.col("_bid").isNotNull())
    if not centres:
        return _named(q.join(cells, F.lit(False)).select("_qid", "_bid", F.lit(0.0).alias("cosine_distance"),
                                                         F.lit(1).alias("neighbour_rank")), query_id)
    # rows in pieces of neighbouring cells, queries in blocks: both bounded, and written
    # once, so that a row keeps its piece whatever is computed again
    parts = lambda df: _parts(df.count(), len(centres[0]))
    n_pieces, n_blocks = parts(cells), parts(q)
    pieces = cells.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(n_pieces, "_cell", "_n").drop("_n")
    pieces = scratch_table(pieces.withColumn("_piece", F.spark_partition_id()), "knn_pieces")
    blocks = scratch_table(q.repartition(n_blocks).withColumn("_block", F.spark_partition_id()), "knn_blocks")
    held = [(r["_piece"], r["_cell"]) for r in pieces.select("_piece", "_cell").distinct().collect()]

    def top(scored: DataFrame) -> DataFrame:
        w = Window.partitionBy("_qid").orderBy("cosine_distance", "_bid")
        return scored.withColumn("neighbour_rank", F.row_number().over(w)).where(F.col("neighbour_rank") <= k)

    first = top(_search(blocks, pieces, n_blocks, held, Probes(centres, nprobe), k, exclude_self))
    if exact and nprobe < len(centres):
        # k-th distance per query (Euclidean on unit vectors: sqrt(2 * cosine distance));
        # a query with fewer than k hits must look everywhere (bound = +inf).
        kth = first.groupBy("_qid").agg(
            F.max("cosine_distance").alias("_dk_cos"), F.count(F.lit(1)).alias("_found")
        ).select("_qid", F.when(F.col("_found") >= k, F.sqrt(dlit(2.0) * F.greatest(F.col("_dk_cos"), dlit(0.0))))
                 .otherwise(dlit(float("inf"))).alias("_dk"))
        bounded = blocks.join(kth, blocks["_qid"].eqNullSafe(kth["_qid"]), "left").select(
            blocks["_qid"], "_qunit", "_block", F.coalesce("_dk", dlit(float("inf"))).alias("_dk"))
        radius = {r["_cell"]: r["_radius"] for r in radii.collect()}  # nlist numbers
        every = Probes(centres, nprobe, [radius.get(i, 0.0) for i in range(len(centres))])
        first = top(_search(bounded, pieces, n_blocks, held, every, k, exclude_self))
    return _named(first, query_id)


def _named(found: DataFrame, query_id: str) -> DataFrame:
    return found.select(F.col("_qid").alias(query_id), F.col("_bid").alias("neighbour_id"), "cosine_distance", "neighbour_rank")


#: Rows of a piece or block at most (about), their numbers, and rows above which there are several; query rows
#: and base rows of one matrix product.
PART_ROWS, PART_NUMBERS, SPLIT_ROWS, PARTS = 65_536, 1 << 22, 1024, 4
TILE_ROWS, TILE_COLUMNS = 256, 4096
#: Distances and vectors that are looked at together besides: query rows by centres, pairs.
_SOME_ROWS, _SOME_PAIRS = 1024, 1 << 14
#: Above the rounding of a matrix product of unit vectors.
_SLACK = 1e-9
#: Below every cosine.
_LOWEST = -1e30


def _parts(rows: int, dim: int = 1) -> int:
    """Pieces of a table: a few for a small one (so that cores have work), then by its rows and their length."""
    most = max(1, min(PART_ROWS, PART_NUMBERS // max(1, dim)))
    return max(1, min(PARTS, -(-rows // SPLIT_ROWS)), -(-rows // most))


class Probes:
    """Which cells a query searches: the ``nprobe`` nearest centres, or, with the cells'
    radii, those that may hold a row within the query's distance ``_dk``."""

    def __init__(self, centres: list[list[float]], nprobe: int, radii: list[float] | None = None):
        self.centres, self.nprobe, self.radii = centres, nprobe, radii

    def cells(self, q, bound, only=None):
        """(queries x cells) booleans, of the cells ``only`` if given, and each query's nearest cell."""
        c = np.asarray(self.centres, dtype=float)
        only = np.arange(len(c)) if only is None else only
        if self.radii is None and self.nprobe >= len(c):
            return np.ones((len(q), len(only)), bool), np.zeros(len(q), np.int64)
        found = [self._some(q[at : at + _SOME_ROWS], bound[at : at + _SOME_ROWS], c) for at in range(0, max(1, len(q)), _SOME_ROWS)]
        return np.concatenate([wanted[:, only] for wanted, _ in found]), np.concatenate([near for _, near in found])

    def _some(self, q, bound, c):
        with np.errstate(invalid="ignore"):
            far = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] - 2.0 * q @ c.T + (c * c).sum(axis=1)[None, :], 0.0))
        near = far.argmin(axis=1)
        if self.radii is not None:  # written so that a distance that is no number prunes nothing
            return ~(far - np.asarray(self.radii)[None, :] > bound[:, None] + 1e-6), near
        far[np.isnan(far)] = np.inf  # last
        last = np.partition(far, self.nprobe - 1, axis=1)[:, self.nprobe - 1 : self.nprobe]
        wanted, tied = far < last, far == last
        # of equally far centres the first
        return wanted | (tied & (np.cumsum(tied, axis=1) <= self.nprobe - wanted.sum(axis=1)[:, None])), near


def _matrix(column):
    """An Arrow column of equally long lists as a matrix."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=float).reshape(len(column), -1)


def _first_copies(base, number, base_rank, cell, most: int):
    """Places, by cell, of the rows that can count: of equal vectors of a cell (and of those that aren't
    ``number``s, whose distances are none) only the ``most`` of lowest rank."""
    bits = np.ascontiguousarray(base).view(np.int64)
    factors = np.random.default_rng(1).integers(1 << 62, size=base.shape[1]) * 2 + 1
    mixed = np.where(number, bits @ factors, 0)  # equal vectors have equal sums; others are told apart below
    order = np.lexsort((base_rank, mixed, number, cell))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (cell[a] != cell[b]) | (mixed[a] != mixed[b]) | (number[a] != number[b])
    close = np.flatnonzero(~new[1:] & number[a])
    for at in range(0, len(close), _SOME_PAIRS):
        some = close[at : at + _SOME_PAIRS]
        new[1 + some] = (bits[a[some]] != bits[b[some]]).any(axis=1)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    order = order[place < most]
    return order[np.lexsort((base_rank[order], cell[order]))]


def _places(mask):
    """The places of a matrix's few true values: row and column."""
    flat = np.ascontiguousarray(mask).reshape(-1)
    if flat.size % 8:
        at = np.flatnonzero(flat)
    else:  # eight at a time
        words = np.flatnonzero(flat.view(np.uint64))
        word, byte = np.nonzero(flat.reshape(-1, 8)[words])
        at = words[word] * 8 + byte
    return at // mask.shape[1], at % mask.shape[1]


def _exact(q, a, base, b):
    """Distances of pairs, summed from left to right, as SQL does."""
    out = np.empty(len(a))
    for at in range(0, len(a), _SOME_PAIRS):
        v, w = q[a[at : at + _SOME_PAIRS]], base[b[at : at + _SOME_PAIRS]]
        with np.errstate(invalid="ignore", over="ignore"):
            total = v[:, 0] * w[:, 0] if v.shape[1] else np.zeros(len(v))
            for j in range(1, v.shape[1]):
                total = total + v[:, j] * w[:, j]
        out[at : at + _SOME_PAIRS] = 1.0 - total
    return out


def _own_rows(q_rank, by_rank, sorted_rank):
    """(query, base place) of the base rows that have a query's id."""
    low, high = (np.searchsorted(sorted_rank, q_rank, side=s) for s in ("left", "right"))
    times = high - low
    a = np.repeat(np.arange(len(q_rank)), times)
    return a, by_rank[np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]


class _Pool:
    """The rows, with their cosines (about), that may be among the ``k`` nearest of a tile's queries."""

    def __init__(self, least, k: int, eps: float):
        #: Cosine below which a query needs no row.
        self.least, self.k, self.eps = least, k, eps
        self.a, self.b, self.s, self.held, self.room = [], [], [], 0, 0

    def add(self, a, b, s) -> None:
        self.a.append(a)
        self.b.append(b)
        self.s.append(s)
        self.held += len(a)
        if self.held > self.room:
            self.shrink()
            self.room = 2 * self.held + len(self.least) * self.k

    def shrink(self) -> None:
        a, b, s = (np.concatenate(x) for x in (self.a, self.b, self.s))
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        place = np.arange(len(a)) - np.searchsorted(a, a, side="left")
        kth = place == self.k - 1
        self.least[a[kth]] = np.maximum(self.least[a[kth]], s[kth] - self.eps)
        keep = s >= self.least[a]
        self.a, self.b, self.s, self.held = [a[keep]], [b[keep]], [s[keep]], int(keep.sum())


def nearest_rows(q, q_rank, wanted, near, base, base_rank, cell, k: int, exclude_self: bool, bound=None):
    """(query place, base place, distance) of every query's ``k`` nearest rows (ties: lower rank) among
    those of its ``wanted`` cells (a column for each cell number in ``cell``, ascending) and, with ``bound``,
    among those that far at most. Single-precision matrix products pick the rows that can be among them, by
    a margin above their rounding; the distances of these are summed exactly and ranked."""
    copies = int(np.unique(base_rank, return_counts=True)[1].max()) if exclude_self and len(base) else 0
    number, asks = np.isfinite(base).all(axis=1), np.isfinite(q).all(axis=1)
    kept = _first_copies(base, number, base_rank, cell, k + copies)
    column = np.unique(cell, return_inverse=True)[1].ravel()
    odd, order = kept[~number[kept]], kept[number[kept]]
    rank, column_of = base_rank[order], column[order]
    few, fast = base.astype(np.float32)[order], q.astype(np.float32)
    squares = [np.einsum("ij,ij->i", x, x)[use] for x, use in ((base, number), (q, asks))]
    eps = (base.shape[1] + 8) * 2.0**-23 * max(1.0, *(float(x.max()) for x in squares if len(x)), 1.0)
    ends = np.searchsorted(column_of, np.arange(wanted.shape[1] + 1))
    sizes = np.diff(ends)
    by_rank = np.argsort(rank, kind="stable")
    sorted_rank = rank[by_rank]
    out = []
    queries = np.flatnonzero(asks)
    queries = queries[np.argsort(near[queries], kind="stable")]  # queries near one another want the same cells
    for at in range(0, len(queries), TILE_ROWS):
        tile = queries[at : at + TILE_ROWS]
        want = wanted[tile]
        some, every = want.any(axis=0), bool(want.all())
        columns = np.arange(len(order)) if every else np.flatnonzero(np.repeat(some, sizes))
        pool = _Pool(np.full(len(tile), _LOWEST), k, eps)
        if bound is not None:
            limit = 1.0 - bound[tile] * bound[tile] / 2.0 - eps - _SLACK
            pool.least[np.isfinite(limit)] = limit[np.isfinite(limit)]
        own_a = own_at = np.zeros(0, np.int64)
        if exclude_self:
            own_a, own_b = _own_rows(q_rank[tile], by_rank, sorted_rank)
            own_at = np.searchsorted(columns, own_b)
            here = np.flatnonzero(own_at < len(columns))
            here = here[columns[own_at[here]] == own_b[here]]
            own_a, own_at = own_a[here], own_at[here]
        for start in range(0, len(columns), TILE_COLUMNS):
            part = slice(start, start + TILE_COLUMNS) if every else columns[start : start + TILE_COLUMNS]
            mine = (own_at >= start) & (own_at < start + TILE_COLUMNS)

            def cosines(v, w):
                s = v[tile] @ w.T  # noqa: B023
                s[own_a[mine], own_at[mine] - start] = -np.inf  # noqa: B023
                return s

            def masked(s, who):
                if not every:  # noqa: B023
                    s[~want[who][:, column_of[part]]] = -np.inf  # noqa: B023
                return s

            s = cosines(fast, few[part])
            fresh = np.flatnonzero(pool.least <= _LOWEST)  # queries that have no k rows yet
            if len(fresh):
                first = masked(s[fresh], fresh)
                if s.shape[1] > k:
                    kth = np.partition(first, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    pool.least[fresh] = np.maximum(pool.least[fresh], kth - eps)
                s[fresh] = first
            # rounded down: what is single in a comparison must not pass over a row
            a, b = _places(s >= np.nextafter(pool.least.astype(np.float32), np.float32(-np.inf))[:, None])
            if len(a) > max(s.size // 16, len(tile) * k * 4):  # many rows within the rounding: closer
                s = masked(cosines(q, base[order[part]]), slice(None))
                if s.shape[1] > k:
                    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    a, b = _places((s >= kth[:, None] - _SLACK) & (s >= pool.least[:, None]))
                else:
                    a, b = _places(s >= pool.least[:, None])
            found, b = s[a, b].astype(float), b + start
            if not every:
                b = columns[b]
                inside = want[a, column_of[b]]
                a, b, found = a[inside], b[inside], found[inside]
            if len(a):
                pool.add(a, b, found)
        if pool.held:
            pool.shrink()
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pool.a, pool.b))
        short = tile[np.bincount(a, minlength=len(tile)) < k] if len(odd) else tile[:0]
        a, b = tile[a], order[b]
        found = [(a, b, _exact(q, a, base, b))]
        if len(short):  # distances that are no numbers come last
            found.append(_odd_pairs(short, q_rank, wanted, odd, base_rank, column, exclude_self))
        out.append(_best(found, base_rank, k))
    asking = np.flatnonzero(~asks)
    if len(asking):  # no distance of theirs is a number; they all want the same cells
        ranked = kept[wanted[asking[0]][column[kept]]]
        ranked = ranked[np.argsort(base_rank[ranked], kind="stable")][: k + copies]
        for at in range(0, len(asking), TILE_ROWS):
            tile = asking[at : at + TILE_ROWS]
            out.append(_best([_odd_pairs(tile, q_rank, wanted, ranked, base_rank, column, exclude_self)], base_rank, k))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _odd_pairs(tile, q_rank, wanted, rows, base_rank, column, exclude_self: bool):
    """Pairs of some queries and rows whose distances are no numbers."""
    use = wanted[tile][:, column[rows]]
    if exclude_self:
        use &= q_rank[tile][:, None] != base_rank[rows][None, :]
    a, b = np.nonzero(use)
    return tile[a], rows[b], np.full(len(a), np.nan)


def _best(found, rank, k: int):
    """The first ``k`` of every query by distance (what is no number last) and rank."""
    a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
    o = np.lexsort((rank[b], d, a))
    a, b, d = a[o], b[o], d[o]
    first = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
    return a[first], b[first], d[first]


def _search(blocks: DataFrame, pieces: DataFrame, n_blocks: int, held: list[tuple[int, int]], probes: Probes, k: int,
            exclude_self: bool) -> DataFrame:
    """``(_qid, _bid, cosine_distance)``: for every query row and piece its ``k`` nearest rows. A
    task holds one block of queries and one piece; a query goes to the pieces of its cells only."""
    n_cells, n_pieces = len(probes.centres), max((p for p, _ in held), default=0) + 1
    where = np.zeros((n_cells, n_pieces), bool)
    for piece, cell in held:
        where[cell, piece] = True

    @F.arrow_udf("array<int>")
    def asked(vectors: pa.Array, bound: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        q, bound, sent = _matrix(pa.chunked_array([vectors])), bound.to_numpy(zero_copy_only=False), []
        for at in range(0, len(q), _SOME_ROWS):
            wanted, _ = probes.cells(q[at : at + _SOME_ROWS], bound[at : at + _SOME_ROWS])
            sent.append((wanted.astype(np.float32) @ where.astype(np.float32)) > 0)
        sent = np.concatenate(sent)
        ends = np.append(0, np.cumsum(sent.sum(axis=1)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(sent)[1], pa.int32()))

    bound = F.col("_dk") if "_dk" in blocks.columns else dlit(0.0)
    ask = blocks.select("_qid", "_qunit", "_block", bound.alias("_dk"))
    ask = ask.withColumn("_piece", F.explode(asked("_qunit", "_dk")))
    dealt = pieces.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    id_types = blocks.schema["_qid"].dataType.simpleString(), pieces.schema["_bid"].dataType.simpleString()

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_qid", "_bid", "cosine_distance"]
        kinds = [left.schema.field("_qid").type, right.schema.field("_bid").type, pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        ids = pa.concat_arrays([c.cast(right.schema.field("_bid").type) for t, n in ((left, "_qid"), (right, "_bid")) for c in t[n].chunks])
        rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        q, bound, cell = _matrix(left["_qunit"]), left["_dk"].to_numpy(), right["_cell"].to_numpy().astype(np.int64)
        wanted, near = probes.cells(q, bound, np.unique(cell))
        a, b, d = nearest_rows(q, rank[: len(q)], wanted, near, _matrix(right["_unit"]), rank[len(q) :], cell, k,
                               exclude_self, None if probes.radii is None else bound)
        return pa.table([left["_qid"].take(pa.array(a)), right["_bid"].take(pa.array(b)), pa.array(d)], names=names)

    return ask.groupBy("_block", "_piece").cogroup(dealt.groupBy("_block", "_piece")).applyInArrow(
        nearest, f"_qid {id_types[0]}, _bid {id_types[1]}, cosine_distance double"
    )
