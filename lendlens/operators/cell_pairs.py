"""The top ``k`` partners of every application within cells of few rows, for long vectors (M4).

Joining a cell's rows and then fetching the vectors of every pair by id moves a vector for each pair whose numbers
agree, twice. Here a row's vector goes along with its copies, packed, and a cell's pairs are made where its rows lie:

1. Vectors are packed: a bitmap of the numbers that aren't zero, and these numbers.
2. All copies of a cell are dealt to one task and sorted by cell, own rows first; they come in Arrow batches.
3. The cells that a batch ends are searched at once: a row's partners lie in a run of its cell's rows by their
   loans, so a cell needs no narrow bounds; pairs in slices of bounded size, the cheap predicates first, then the distances (summed from left to right, as the join does), then the best ``k``. A cell that goes on is
   held; beyond ``HELD_ROWS`` rows only its own rows and their best partners so far.

No pair leaves its task but those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dense_pairs import Limits

#: Rows of an unfinished cell that are held, pairs that are looked at together, and those of them by their vectors.
HELD_ROWS, SLICE_PAIRS, SLICE_VECTORS = 20_000, 1 << 18, 1 << 13


def _lists(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of every number of a list column, and the numbers (a missing one is none)."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths), values


def _bits(vectors: pa.Array) -> pa.Array:
    row, place, values = _lists(vectors)
    mask = np.zeros((len(vectors), int(place.max()) + 1 if len(place) else 0), bool)
    mask[row, place] = values.view(np.int64) != 0
    return pa.array([x.tobytes() for x in np.packbits(mask, axis=1)], pa.binary())


def _values(vectors: pa.Array) -> pa.Array:
    row, _, values = _lists(vectors)
    some = values.view(np.int64) != 0
    ends = np.append(0, np.cumsum(np.bincount(row[some], minlength=len(vectors))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[some]))


def packed(vector: Column) -> dict[str, Column]:
    """The columns that hold a vector without its zeros; :func:`unpacked` puts it together."""
    return {"_dim": F.size(vector), "_bits": F.arrow_udf(_bits, "binary")(vector), "_values": F.arrow_udf(_values, "array<double>")(vector)}


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as a matrix, filled up with zeros, and their lengths."""
    dim = rows["_dim"].to_numpy().astype(np.int64)
    bits = rows["_bits"].combine_chunks()
    wide = pc.binary_length(bits).to_numpy(zero_copy_only=False).astype(np.int64)
    packs = np.zeros((len(wide), int(wide.max()) if len(wide) else 0), np.uint8)
    row = np.repeat(np.arange(len(wide)), wide)
    packs[row, np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)] = np.frombuffer(b"".join(bits.to_pylist()), np.uint8)
    mask = np.unpackbits(packs, axis=1).astype(bool)
    out = np.zeros(mask.shape)
    out[mask] = _lists(rows["_values"].combine_chunks())[2]
    return out[:, : int(dim.max()) if len(dim) else 0], dim


def _borders(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where cells begin in rows sorted by them."""
    new = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        new[1:] = False
        for key in keys:
            column = rows[key].combine_chunks()
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def search(rows: pa.Table, starts: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base place, similar place, distance): the best partners of the own rows in their cells."""
    n = rows.num_rows
    cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    rank = pc.rank(rows["_id"].combine_chunks(), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    income, loan, dti = (np.asarray(rows[c].to_numpy(), dtype=float) for c in ("_income", "_loan", "_dti"))
    vec, dim = unpacked(rows)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.zeros(n)
        for j in range(vec.shape[1]):
            norm = norm + vec[:, j] * vec[:, j]
        norm = np.sqrt(norm)
    # a loan that is no finite number has no partner
    known = np.flatnonzero(np.isfinite(loan))
    own = known[rows["_own"].to_numpy(zero_copy_only=False)[known]]
    out, begin = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    if not len(own):
        return out[0]
    # the rows of a cell by their loans: partners lie within reach, a run of places
    height = np.log(loan[known])
    height -= height.min()
    span = float(height.max())
    reach = min(limits.reach()[1] * (1 + 1e-9), span)
    at = np.full(n, np.nan)
    at[known] = cell[known] * (span + 2 * reach + 1) + height
    order = known[np.argsort(at[known], kind="stable")]
    low, high = np.searchsorted(at[order], at[own] - reach - 1e-7), np.searchsorted(at[order], at[own] + reach + 1e-7, side="right")
    ends = np.cumsum(high - low)
    while begin < len(own):
        before = ends[begin - 1] if begin else 0
        some = slice(begin, max(begin + 1, int(np.searchsorted(ends, before + SLICE_PAIRS, side="right"))))
        times = high[some] - low[some]
        a = np.repeat(own[some], times)
        b = order[np.arange(len(a)) + np.repeat(low[some] - np.cumsum(times) + times, times)]
        out.append(_ranked(*_near(a, b, rank, income, loan, dti, vec, dim, norm, limits), cell, rank, income, loan, dti, limits.k))
        begin = some.stop
    # rows of one id may have been in several slices
    return _ranked(*(np.concatenate(x) for x in zip(*out, strict=True)), cell, rank, income, loan, dti, limits.k)


def _near(a, b, rank, income, loan, dti, vec, dim, norm, limits: Limits):
    """Those of the pairs that meet the predicates, and their distances."""

    def only(keep):
        nonlocal a, b
        a, b = a[keep], b[keep]

    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        only(np.abs(dti[a] - dti[b]) < min(limits.band_dti, limits.dti_tol))
        only(rank[a] != rank[b] if limits.both_directions else rank[a] < rank[b])
        for value, tol in ((income, limits.income_tol), (loan, limits.loan_tol)):
            x, y = value[a], value[b]
            only((np.abs(x - y) / np.maximum(x, y) < tol) & (x >= y * limits.band_low) & (x <= y * limits.band_high))
        only((dim[a] == dim[b]) & (norm[a] > 0) & (norm[b] > 0))
        distance = np.empty(len(a))
        for at in range(0, len(a), SLICE_VECTORS):
            i, j = a[at : at + SLICE_VECTORS], b[at : at + SLICE_VECTORS]
            v, w = vec[i].T.copy(), vec[j].T.copy()
            total = np.zeros(len(i))
            for x, y in zip(v, w, strict=True):
                total = total + x * y
            distance[at : at + SLICE_VECTORS] = 1.0 - total / (norm[i] * norm[j])
        near = distance < limits.max_distance
    return a[near], b[near], distance[near]


def _ranked(a, b, distance, cell, rank, income, loan, dti, k: int):
    """The first ``k`` pairs of every base id in its cell."""
    with np.errstate(invalid="ignore"):
        apart = [np.abs(x[a] - x[b]) / np.maximum(x[a], x[b]) for x in (income, loan)]
    order = np.lexsort((rank[b], np.abs(dti[a] - dti[b]), apart[1], apart[0], distance, rank[a], cell[a]))
    a, b, distance = a[order], b[order], distance[order]
    new = np.ones(len(a), bool)
    new[1:] = (rank[a[1:]] != rank[a[:-1]]) | (cell[a[1:]] != cell[a[:-1]])
    first = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) < k
    return a[first], b[first], distance[first]


def found_in(batches: Iterator[pa.RecordBatch], keys: Sequence[str], limits: Limits) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray]]:
    """Base rows, similar rows and distances of the best pairs in a stream of rows sorted by cell, own rows first."""

    def pairs(rows: pa.Table, starts: np.ndarray):
        a, b, distance = search(rows, starts, limits)
        if len(a):
            yield rows.take(pa.array(a)), rows.take(pa.array(b)), distance

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        if not rows.num_rows:
            continue
        starts = _borders(rows, keys)
        if len(starts) > 1:
            yield from pairs(rows[: starts[-1]], starts[:-1])
        held = rows[starts[-1] :].combine_chunks()
        if held.num_rows > HELD_ROWS and not held["_own"][-1].as_py():  # all of its own rows are there
            use = held["_own"].to_numpy(zero_copy_only=False).copy()
            use[search(held, np.zeros(1, np.int64), limits)[1]] = True
            held = held.take(pa.array(np.flatnonzero(use)))
    if held is not None:
        yield from pairs(held, np.zeros(1, np.int64))


def top_pairs(copies: DataFrame, keys: Sequence[str], block: Sequence[str], sides: dict[str, str], limits: Limits) -> DataFrame:
    """The pairs of every own row with its best ``limits.k`` partners in its cell: ``block``, the columns ``sides``
    of both rows (by name, with what stands behind ``base_`` and ``similar_``), ``financial_similarity_distance``.

    ``copies``: ``keys`` (the cell), ``_own``, ``_id, _income, _loan, _dti``, a packed vector and the columns of
    ``sides``, each row in every cell where it may be a partner."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in copies.schema.fields}
    names = {"base": [f"base_{n}" for n in sides.values()], "similar": [f"similar_{n}" for n in sides.values()]}
    schema = [f"{c} {types[c]}" for c in block] + [f"{n} {types[c]}" for side in names.values() for c, n in zip(sides, side, strict=True)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, similar, distance in found_in(batches, keys, limits):
            columns = [base[c] for c in block] + [x[c] for x in (base, similar) for c in sides] + [pa.chunked_array([distance])]
            yield from pa.table(columns, names=[*block, *names["base"], *names["similar"], "financial_similarity_distance"]).to_batches()

    # a number first, which is told at once where the cells' names begin alike
    dealt = copies.repartition(*keys).withColumn("_cell", F.xxhash64(*keys)).sortWithinPartitions("_cell", *keys, F.col("_own").desc())
    return dealt.mapInArrow(find, ", ".join([*schema, "financial_similarity_distance double"]))
