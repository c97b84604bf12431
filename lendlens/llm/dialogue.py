"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation is brought to the form "system? (user assistant)+", or to nothing, by
the cheapest edits of its rows in turn order. After each row the repaired text so far
ends in one of four states (empty, system, user, assistant), so a row is a 4 x 4
table of costs, and so is any run of rows. Costs alone don't name the edits, and
keeping a pointer a row and state is what Hirschberg avoids: a forward cost vector
from the left and a backward one from the right meet in the middle of the run; the
state in which the best path crosses the middle splits the problem in two, each
solved alike, with memory for the rows and a few vectors.

Ties go to the least audit, the string of edit initials. Audits of the same rows
are never prefixes of one another (each ends in the letter of the last row), so
the order of the four best audits is carried along as ranks, and of the crossings
of equal cost the one with the least rank on its left is on the least audit.

On Spark: rows are sorted by a range partitioning, so a long conversation lies in
many partitions; each partition cuts its conversations into blocks. The blocks of
a conversation that has several are chained by their 4 x 4 tables, by the same
recursion, which fixes the state at each border; then all blocks are solved apart,
those of like length together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of a block: what one recursion holds at once.
BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
#: Codes of a row: 2 * class of the role's initial (s, u, a, other) + truncated, or one of these.
_MUST_GO, _NOTHING = 8, 9
_NAME = {USER: "user", ASSISTANT: "assistant"}
_BLANK = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def _next(state: int) -> int:
    """The only state that a user or assistant row can lead to."""
    return ASSISTANT if state == USER else USER


def _row_options(code: int) -> Iterator[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of every way to take one row."""
    for start in range(4):
        state, cost, edits = start, 0, ""
        for _ in range(3):  # a third insert would only come back to the state of the first
            yield start, state, cost + DELETE, edits + "D"
            if code != _MUST_GO:
                initial, late = divmod(code, 2)
                kept = {0: state == EMPTY, 1: state != USER, 2: state == USER}.get(initial, False)
                if kept:
                    yield start, initial + 1, cost + KEEP + late * TRUNCATED, edits + "K"
                yield start, _next(state), cost + REROLE + late * TRUNCATED, edits + "R"
            state, cost, edits = _next(state), cost + INSERT, edits + "I"


def _tables() -> tuple[np.ndarray, np.ndarray, list[list[list[str]]]]:
    """Costs and ranks [code, before, after], and the edits, of one row."""
    cost, rank = np.full((10, 4, 4), _FAR, np.int64), np.zeros((10, 4, 4), np.int64)
    edits = [[[""] * 4 for _ in range(4)] for _ in range(10)]
    for code in range(9):
        for start, end, price, word in _row_options(code):
            if (price, word) < (cost[code, start, end], edits[code][start][end]) or cost[code, start, end] == _FAR:
                cost[code, start, end], edits[code][start][end] = price, word
        for start in range(4):
            order = sorted(range(4), key=lambda t: (cost[code, start, t] >= _FAR, edits[code][start][t]))
            for place, t in enumerate(order):
                rank[code, start, t] = place
    cost[_NOTHING][np.diag_indices(4)] = 0  # fills runs up to a common length
    return cost, rank, edits


_COST, _RANK, _EDITS = _tables()
#: Cheapest inserts that end a conversation, by the state it is in.
_TAIL = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


# ---- Hirschberg, for many runs of one length at once ------------------------------


def _forward(cost: np.ndarray, rank: np.ndarray, runs: np.ndarray, lo: int, hi: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and audit ranks [run, state] after the elements lo .. hi-1."""
    n = len(runs)
    f = np.full((n, 4), _FAR, np.int64)
    f[np.arange(n), entry] = 0
    r = np.zeros((n, 4), np.int64)
    for k in range(lo, hi):
        c = cost[runs[:, k]]
        every = f[:, :, None] + c
        best = every.min(axis=1)
        come = np.where(every == best[:, None, :], r[:, :, None], 99).argmin(axis=1)
        key = np.take_along_axis(r, come, 1) * 4 + np.take_along_axis(rank[runs[:, k]], come[:, None, :], 1)[:, 0, :]
        key[best >= _FAR] = 99
        f, r = np.minimum(best, _FAR), (key[:, None, :] < key[:, :, None]).sum(axis=2)
    return f, r


def _backward(cost: np.ndarray, runs: np.ndarray, lo: int, hi: int, end: np.ndarray) -> np.ndarray:
    """Costs [run, state] of the elements lo .. hi-1 and what follows."""
    b = end
    for k in range(hi - 1, lo - 1, -1):
        b = np.minimum((cost[runs[:, k]] + b[:, None, :]).min(axis=2), _FAR)
    return b


def hirschberg(cost: np.ndarray, rank: np.ndarray, runs: np.ndarray, entry: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The states [run, place] along the audit-least best path of each run. ``runs`` [run,
    place] names elements of the tables ``cost`` and ``rank`` [element, before, after];
    ``entry`` is the state before a run and ``end`` the costs after it, by state."""
    n, length = runs.shape
    states = np.zeros((n, length + 1), np.int64)
    states[:, 0] = entry
    todo = [(0, length, end)] if length else []
    while todo:  # left parts first: a part's entry is known when it is taken up
        lo, hi, tail = todo.pop()
        mid = (lo + hi) // 2 if hi - lo > 1 else hi
        f, r = _forward(cost, rank, runs, lo, mid, states[:, lo])
        total = f + (_backward(cost, runs, mid, hi, tail) if mid < hi else tail)
        cross = np.where(total == total.min(axis=1, keepdims=True), r, 99).argmin(axis=1)
        states[:, mid] = cross
        if hi - lo > 1:
            onto = np.full((n, 4), _FAR, np.int64)
            onto[np.arange(n), cross] = 0
            todo.append((mid, hi, tail))
            if mid - lo > 1:
                todo.append((lo, mid, onto))
    return states


def _padded(codes: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places of the runs in ``codes`` by length up to a power of two, and their codes."""
    groups: dict[int, list[int]] = {}
    for k, run in enumerate(codes):
        groups.setdefault(max(len(run) - 1, 0).bit_length(), []).append(k)
    for bits, places in groups.items():
        out = np.full((len(places), 1 << bits), _NOTHING, np.uint8)
        for row, k in enumerate(places):
            out[row, : len(codes[k])] = np.frombuffer(codes[k], np.uint8)
        yield places, out


def _end_costs(exits: np.ndarray) -> np.ndarray:
    """Costs by state after a run: nothing but the known exit, or the tail of a conversation (-1)."""
    end = np.full((len(exits), 4), _FAR, np.int64)
    inner = exits >= 0
    end[inner, exits[inner]] = 0
    end[~inner] = _TAIL
    return end


def solve(codes: list[bytes], entry: np.ndarray, exits: np.ndarray) -> list[np.ndarray]:
    """States before the first and after each row of every run."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(codes)
    for places, runs in _padded(codes):
        states = hirschberg(_COST, _RANK, runs, entry[places], _end_costs(exits[places]))
        for row, k in enumerate(places):
            out[k] = states[row, : len(codes[k]) + 1]
    return out


def block_tables(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Costs and ranks [run, before, after] of whole runs."""
    cost, rank = np.full((len(codes), 4, 4), _FAR, np.int64), np.zeros((len(codes), 4, 4), np.int64)
    for places, runs in _padded(codes):
        for state in range(4):
            f, r = _forward(_COST, _RANK, runs, 0, runs.shape[1], np.full(len(places), state))
            cost[places, state], rank[places, state] = f, r
    return cost, rank


# ---- the rows ---------------------------------------------------------------------


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the contract fixes: crc32 of
    ``conv_id:turn`` modulo 20 drops a row (0), empties its text (1), strips its sentence
    ends (2), repeats it (3) or makes its role user (4). A null is read as one space."""
    draw = F.crc32(F.encode(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")), "UTF-8")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(_or_space("text"), "[.!?]", "")).otherwise(_or_space("text"))
    rows = conversations.filter(draw != 0).select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(_or_space("role")).alias("role"), text.alias("text"),
        F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


_ORDER = ["conv_id", "turn", "role", "k"]


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with k, the 128-bit hash by which texts are compared."""
    return rows.select("conv_id", "turn", _or_space("role").alias("role"), _or_space("text").alias("text")).withColumn(
        "k", F.unhex(F.md5(F.encode("text", "UTF-8")))
    )


def graded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, k, n (rows alike in these), blank, again (seen at an earlier
    turn), truncated, initial. Equal rows are counted before anything is moved."""
    alike = _keyed(rows).groupBy(*_ORDER).agg(
        F.count("*").alias("n"), F.first(~F.col("text").rlike(_BLANK)).alias("blank"), F.first(~F.col("text").rlike(_ENDED)).alias("truncated")
    )
    alike = common.stage(alike, "alike")
    turn = F.struct(F.col("turn").isNotNull().alias("t"), F.col("turn").alias("v"))
    first = alike.groupBy("conv_id", "role", "k").agg(F.count("*").alias("c"), F.min(turn).alias("first"))
    first = first.filter("c > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("k").alias("_k"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("k") == F.col("_k"))
    initial = F.substring("role", 1, 1)
    return alike.join(first, same, "left").select(
        *_ORDER, "n", "blank", (F.col("first").isNotNull() & (turn != F.col("first"))).alias("again"), "truncated",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
    )


def blocks(alike: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs of at most ``block`` rows of one conversation of ``graded`` rows, in order of
    ``seq``: the rows' codes, and the turn, role, hash and place of those that can stay."""
    kind = alike.schema["conv_id"].dataType.simpleString(), alike.schema["turn"].dataType.simpleString()
    row = f"array<struct<at: int, turn: {kind[1]}, role: string, k: binary>>"
    schema = f"conv_id {kind[0]}, seq long, codes binary, illegal long, first int, last int, rows {row}"
    gone = F.col("blank") | F.col("again")
    code = F.when(gone, _MUST_GO).otherwise(F.col("initial") * 2 + F.col("truncated").cast("int"))
    ranged = alike.withColumn("code", code).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 40
        out: dict[str, list] = {}
        types: pa.Schema | None = None
        conv, open_ = None, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal seq, open_, out
            if open_ is not None:
                values = conv, seq, bytes(open_["codes"]), open_["illegal"], open_["first"], open_["last"], open_["rows"]
                for field, value in zip(types, values, strict=True):
                    out.setdefault(field.name, []).append(value)
                seq, open_ = seq + 1, None
                if len(out["seq"]) >= 1000:
                    yield flush()

        def flush() -> pa.RecordBatch:
            nonlocal out
            batch = pa.RecordBatch.from_arrays([pa.array(out.get(f.name, []), f.type) for f in types], schema=types)
            out = {}
            return batch

        for batch in batches:
            if types is None:
                each = pa.struct([("at", pa.int32()), ("turn", batch.schema.field("turn").type), ("role", pa.string()), ("k", pa.binary())])
                types = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("seq", pa.int64()), ("codes", pa.binary()), ("illegal", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("rows", pa.list_(each))])
            for c, turn, role, k, n, code, initial in zip(*(batch.column(name).to_pylist() for name in (*_ORDER, "n", "code", "initial")), strict=True):
                if open_ is None or c != conv:
                    yield from close()
                    conv = c
                left, new = n, code
                while left:  # the first of equal rows may stay, the others go
                    if open_ is None:
                        open_ = {"codes": bytearray(), "illegal": 0, "first": initial, "last": None, "rows": []}
                    if open_["last"] is not None:
                        open_["illegal"] += _broken(open_["last"], initial)
                    if new != _MUST_GO:
                        open_["rows"].append({"at": len(open_["codes"]), "turn": turn, "role": role, "k": k})
                    take = 1 if new != _MUST_GO else min(left, block - len(open_["codes"]))
                    open_["codes"] += bytes([new]) * take
                    open_["illegal"] += (take - 1) * _broken(initial, initial)
                    open_["last"], left, new = initial, left - take, _MUST_GO
                    if len(open_["codes"]) >= block:
                        yield from close()
        yield from close()
        if types is not None and out:
            yield flush()

    columns = ranged.select(*_ORDER, "n", F.col("code").cast("int").alias("code"), F.col("initial").cast("int").alias("initial"))
    return common.stage(columns.mapInArrow(cut, schema), "blocks")


def _broken(before: int, after: int) -> int:
    """1 if two neighbouring roles (s, u, a, other as 0 .. 3) may not follow each other."""
    return int((before, after) not in ((0, 1), (1, 2), (2, 1)))


def borders(cut: DataFrame) -> DataFrame:
    """(seq, entry, exit, between) for the blocks of conversations with several: the states
    at their borders, and whether the rows that meet there break the order of roles."""
    several = cut.groupBy("conv_id").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("conv_id").alias("_c"))
    parts = cut.join(several, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "seq", "codes", "first", "last")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, rank = block_tables(batch.column("codes").to_pylist())
            numbers = [pa.array(list(t.reshape(-1, 16)), pa.list_(pa.int64())) for t in (cost, rank)]
            picked = [batch.column(name) for name in ("conv_id", "seq", "first", "last")]
            yield pa.RecordBatch.from_arrays([*picked, *numbers], names=["conv_id", "seq", "first", "last", "cost", "rank"])

    conv = cut.schema["conv_id"].dataType.simpleString()
    summed = parts.mapInArrow(tables, f"conv_id {conv}, seq long, first int, last int, cost array<long>, rank array<long>")

    def chain(table: pa.Table) -> pa.Table:
        # a conversation's audit is one string of fewer than 2^31 letters, so at most 2^21 blocks of 4 x 4 numbers
        table = table.sort_by("seq")
        m = table.num_rows
        cost, rank = (np.array(table.column(c).to_pylist(), np.int64).reshape(m, 4, 4) for c in ("cost", "rank"))
        states = hirschberg(cost, rank, np.arange(m)[None, :], np.zeros(1, np.int64), _TAIL[None, :])[0]
        first, last = table.column("first").to_pylist(), table.column("last").to_pylist()
        between = [0] + [_broken(a, b) for a, b in zip(last, first[1:], strict=False)]
        exits = np.append(states[1:-1], -1)
        return pa.table({"seq": table.column("seq"), "entry": pa.array(states[:-1], pa.int32()), "exit": pa.array(exits, pa.int32()), "between": pa.array(between, pa.int32())})

    return summed.groupBy("conv_id").applyInArrow(chain, "seq long, entry int, exit int, between int")


def edits(cut: DataFrame) -> DataFrame:
    """conv_id, seq, audit, cost, illegal, kept (turn, role, k of the rows that stay, the lines
    inserted before each and its new role) and tail (lines inserted at the end)."""
    known = cut.join(borders(cut), "seq", "left")
    names = ["conv_id", "seq", "audit", "cost", "illegal", "kept", "tail"]
    turn = cut.schema["rows"].dataType.elementType["turn"].dataType.simpleString()
    kept = f"array<struct<turn: {turn}, role: string, k: binary, before: string, becomes: string>>"
    schema = f"conv_id {cut.schema['conv_id'].dataType.simpleString()}, seq long, audit string, cost long, illegal long, kept {kept}, tail string"

    def inserted(state: int, n: int) -> list[str]:
        out = []
        for _ in range(n):
            state = _next(state)
            out.append(_NAME[state] + ":")
        return out

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            entry, exits = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("entry", "exit"))
            audits, costs, heads, tails = [], [], [], []
            for run, states, rows, last in zip(codes, solve(codes, entry, exits), batch.column("rows").to_pylist(), exits, strict=True):
                path = states.tolist()
                words = [_EDITS[c][a][b] for c, a, b in zip(run, path, path[1:], strict=False)]
                price = int(_COST[np.frombuffer(run, np.uint8), states[:-1], states[1:]].sum())
                # no insert stands before a row that goes (DI is less than ID), so lines are
                # left over at the end of a conversation only
                lines: list[str] = []
                out: list[dict] = []
                by_place = {row["at"]: row for row in rows}
                for at, word in enumerate(words):
                    lines += inserted(path[at], len(word) - 1)
                    if word[-1] != "D":
                        row = by_place[at]
                        role = row["role"] if word[-1] == "K" else _NAME[path[at + 1]]
                        out.append({"turn": row["turn"], "role": row["role"], "k": row["k"], "before": "\n".join(lines) or None, "becomes": role})
                        lines = []
                end = int(_TAIL[path[-1]]) if last < 0 else 0
                lines += inserted(path[-1], end // INSERT)
                audits.append("".join(words) + "I" * (end // INSERT))
                costs.append(price + end)
                heads.append(out)
                tails.append("\n".join(lines) if lines else None)
            each = pa.struct([("turn", batch.schema.field("rows").type.value_type.field("turn").type), ("role", pa.string()), ("k", pa.binary()), ("before", pa.string()), ("becomes", pa.string())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("seq"), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), batch.column("illegal"), pa.array(heads, pa.list_(each)), pa.array(tails, pa.string())],
                names=names,
            )

    common.small_batches(cut.sparkSession)
    found = known.select(
        "conv_id", "seq", "codes", "rows", (F.col("illegal") + F.coalesce("between", F.lit(0))).alias("illegal"),
        F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("exit", F.lit(-1)).alias("exit"),
    )
    return common.stage(found.mapInArrow(repair, schema), "edits")


def _lines(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Kept rows' heads and all rows' texts, side by side in the order of the conversation."""
    head = found.select("conv_id", "seq", F.explode("kept").alias("r")).select(
        "conv_id", F.lit(0).alias("last"), "r.turn", "r.role", "r.k", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("kind"), F.concat_ws("\n", "r.before", "r.becomes").alias("line")
    )
    tail = found.filter("tail IS NOT NULL").select(
        "conv_id", F.lit(1).alias("last"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.lit("").alias("role"), F.lit(b"").alias("k"), "seq", F.lit(2).alias("kind"), F.col("tail").alias("line"),
    )
    texts = _keyed(rows).select("conv_id", F.lit(0).alias("last"), "turn", "role", "k", F.lit(-1).cast("long").alias("seq"), F.lit(1).alias("kind"), F.col("text").alias("line"))
    both = head.unionByName(texts).unionByName(tail)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "last", "turn", "role", "k", "seq", "kind")


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the repaired ``role:text`` lines, as a stream over the
    sorted rows: one line is held at a time."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, begun, head, started = None, hashlib.sha256(), False, None, False
        for batch in batches:
            ids, hashes = [], []
            for c, kind, line in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "kind", "line")), strict=True):
                if not started or c != current:
                    if started:
                        ids.append(current)
                        hashes.append(sha.hexdigest())
                    current, sha, begun, head, started = c, hashlib.sha256(), False, None, True
                if kind == 0:
                    head = line
                    continue
                if kind == 1:
                    if head is None:  # a row that goes
                        continue
                    line, head = f"{head}:{line}", None
                sha.update((f"\n{line}" if begun else line).encode())
                begun = True
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([current], batch.schema.field("conv_id").type), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return _lines(rows, found).select("conv_id", "kind", "line").mapInArrow(digest, f"conv_id {conv}, repaired_sha256 string")


class Repair:
    """The repair of all conversations of ``rows`` (conv_id, turn, role, text; other columns are ignored).

    Rows are taken by turn (null first), then role, then hash of the text, which orders
    rows of one turn; rows alike in all are neighbours. A null conv_id is a conversation
    of its own. Null role or text is one space: a role that must be replaced, a blank
    text. A role is known by its first letter (s, u, a). Texts are compared by 128 bits.
    """

    def __init__(self, rows: DataFrame, block: int = BLOCK) -> None:
        self.source = rows.select("conv_id", "turn", "role", "text")
        self.alike = graded(self.source)
        self.edits = edits(blocks(self.alike, block))

    def rows(self) -> DataFrame:
        """The repaired conversations: conv_id, role, text, and seq, place, line, their order."""
        lines = self.edits.select("conv_id", "seq", F.posexplode("kept").alias("place", "r")).select("conv_id", "seq", "place", "r.*")
        texts = _keyed(self.source).dropDuplicates(_ORDER).alias("t")
        same = F.col("l.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("l.turn").eqNullSafe(F.col("t.turn"))
        same &= (F.col("l.role") == F.col("t.role")) & (F.col("l.k") == F.col("t.k"))
        kept = lines.alias("l").join(texts, same).select(
            "l.conv_id", "l.seq", "l.place", F.lit(1 << 30).alias("line"), F.col("l.becomes").alias("role"), "t.text"
        )
        tails = self.edits.select("conv_id", "seq", F.size("kept").alias("place"), F.col("tail").alias("before"))
        new = lines.select("conv_id", "seq", "place", "before").unionByName(tails).filter("before IS NOT NULL")
        new = new.select("conv_id", "seq", "place", F.posexplode(F.split("before", "\n")).alias("line", "role"))
        return kept.unionByName(new.withColumn("role", F.rtrim("role", F.lit(":"))).withColumn("text", F.lit("")))

    def summary(self, ids: DataFrame) -> DataFrame:
        """One row for every conv_id of ``ids``: gaps, blank, duplicate, truncated, illegal,
        cost, audit, repaired_sha256; zeros, an empty audit and the hash of the empty
        string for a conversation without rows."""
        every = self.alike
        left = ~F.col("blank")
        gaps = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
        counts = every.groupBy("conv_id").agg(
            gaps.cast("long").alias("gaps"),
            F.sum(F.when(left, 0).otherwise(F.col("n"))).alias("blank"),
            F.sum(F.when(left, F.col("n") - F.when(F.col("again"), 0).otherwise(1)).otherwise(0)).alias("duplicate"),
            F.sum(F.when(left & ~F.col("again") & F.col("truncated"), 1).otherwise(0)).alias("truncated"),
        )
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "audit"))), lambda p: p["audit"]), "")
        audits = self.edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
        hashes = repaired_hashes(self.source, self.edits)
        parts = ids.select("conv_id").distinct()
        for part in (counts, audits, hashes):
            parts = parts.unionByName(part, allowMissingColumns=True)
        numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        return parts.groupBy("conv_id").agg(
            *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers),
            F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
            F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return Repair(damaged(rows)).summary(rows)


#: A dynamic program that carries whole audits and texts from row to row: the same result
#: by a plainer and much dearer way. crc32 is built from its rule, byte by byte.
OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), drawn AS (
  SELECT named.*, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS draw
  FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS late
  FROM damaged
), faults AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before
  FROM placed
), graded AS (
  SELECT *, blank OR again AS gone, (late AND NOT blank AND NOT again)::INT AS cut FROM faults
), inserts(state, then_, price, word, lines) AS (
  VALUES ('', '', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
    ('', 'u', 2, 'I', 'user:' || chr(10)), ('s', 'u', 2, 'I', 'user:' || chr(10)), ('a', 'u', 2, 'I', 'user:' || chr(10)),
    ('u', 'a', 2, 'I', 'assistant:' || chr(10)),
    ('', 'a', 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('s', 'a', 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))
), choices(state, initial, then_, price, word) AS (
  VALUES ('', 's', 's', 0, 'K'), ('', 'u', 'u', 0, 'K'), ('s', 'u', 'u', 0, 'K'), ('a', 'u', 'u', 0, 'K'), ('u', 'a', 'a', 0, 'K'),
    ('', NULL, 'u', 2, 'R'), ('s', NULL, 'u', 2, 'R'), ('a', NULL, 'u', 2, 'R'), ('u', NULL, 'a', 2, 'R'),
    ('', NULL, '', 3, 'D'), ('s', NULL, 's', 3, 'D'), ('u', NULL, 'u', 3, 'D'), ('a', NULL, 'a', 3, 'D')
), paths AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS best FROM graded GROUP BY conv_id
  UNION ALL
  SELECT p.conv_id, p.i + 1, c.then_, min({
      'cost': p.best.cost + n.price + c.price + CASE WHEN c.word = 'D' THEN 0 ELSE g.cut END,
      'audit': p.best.audit || n.word || c.word,
      'lines': p.best.lines || n.lines || CASE c.word WHEN 'K' THEN g.role || ':' || g.text || chr(10)
        WHEN 'R' THEN CASE c.then_ WHEN 'u' THEN 'user:' ELSE 'assistant:' END || g.text || chr(10) ELSE '' END})
  FROM paths p JOIN graded g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i + 1
    JOIN inserts n ON n.state = p.state
    JOIN choices c ON c.state = n.then_ AND (c.initial IS NULL OR c.initial = g.initial) AND (c.word = 'D' OR NOT g.gone)
  GROUP BY p.conv_id, p.i, c.then_
), ends AS (
  SELECT p.conv_id, min({'cost': p.best.cost + n.price, 'audit': p.best.audit || n.word, 'lines': p.best.lines || n.lines}) AS best
  FROM paths p JOIN inserts n ON n.state = p.state
  WHERE n.then_ = 'a' AND p.state <> '' OR n.then_ = '' AND p.state = ''
  GROUP BY p.conv_id, p.i
  QUALIFY p.i = max(p.i) OVER (PARTITION BY p.conv_id)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
    sum(again::INT) AS duplicate, sum(cut) AS truncated,
    sum((before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::INT) AS illegal
  FROM graded GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
  coalesce(e.best.audit, '') AS audit,
  sha256(coalesce(left(e.best.lines, greatest(length(e.best.lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
