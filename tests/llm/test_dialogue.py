"""Hirschberg repair against a dynamic program that keeps whole audits."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from lendlens.llm import dialogue

SCHEMA = "conv_id bigint, turn bigint, role string, text string, k int, seq string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        at = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text
        if at:
            out += [(c, t, "user" if at == 4 else role, text)] * (2 if at == 3 else 1)
    return out


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        ink = WORD.findall(text)
        fault = "b" if not ink else "d" if (role, text) in seen else "t" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    # state (last initial so far) -> (cost, audit, lines)
    best = {"": (0, "", [])}

    def inserts(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                role = "assistant" if state == "u" else "user"
                new = (cost + 2, audit + "I", [*lines, role + ":"])
                if role[0] not in best or new[:2] < best[role[0]][:2]:
                    best[role[0]] = new
        return best

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(state, cost, audit, lines):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, lines)

        # the inserts of one row from each state apart, so that ties are weighed whole
        for start, value in best.items():
            for state, (cost, audit, lines) in inserts({start: value}).items():
                offer(state, cost + 3, audit + "D", lines)
                if fault not in ("b", "d"):
                    more = cost + (fault == "t")
                    legal = {"s": state == "", "u": state != "u", "a": state == "u"}
                    if legal.get(role[:1]):
                        offer(role[:1], more, audit + "K", [*lines, f"{role}:{text}"])
                    other = "assistant" if state == "u" else "user"
                    offer(other[0], more + 2, audit + "R", [*lines, f"{other}:{text}"])
        best = new
    ends = [v for s, v in best.items() if s == ""]
    ends += [v for start, value in best.items() if start for s, v in inserts({start: value}).items() if s == "a"]
    cost, audit, lines = min(ends, key=lambda v: v[:2])
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, lines


def brute(rows, damaged=True):
    out = {}
    after = damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for c in {r[0] for r in rows}:
        *values, lines = repair([r for r in after if r[0] == c])
        out[c] = (*values, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    got = df.collect()
    out = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in got}
    assert len(out) == len(got)
    return out


def made(seed, convs=120, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = rng.choice(["Hi.", "Hi.", "No end", "", " \t\n", None, "é! ", f"So {rng.randrange(9)}?", "a\nb.\x0b", "x" * 3000 + "."])
            turn = rng.choice([t, t, t, t + 3, None, 2])
            rows.append((c if c else None, turn, role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def strings(n, seed):
    rng = random.Random(seed)
    return [bytes(rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 9, 16, 17, 40]))) for _ in range(n)]


def test_hirschberg_equals_whole_audits():
    runs = strings(1500, 1)
    for run, states in zip(runs, dialogue.solve(runs, np.zeros(len(runs), np.int64), np.full(len(runs), -1)), strict=True):
        best = {0: (0, "")}
        for code in run:
            new = {}
            for start, end, price, word in dialogue._row_options(code):
                if start in best:
                    value = (best[start][0] + price, best[start][1] + word)
                    new[end] = min(new.get(end, value), value)
            best = new
        want = min((c + int(dialogue._TAIL[s]), a + "I" * int(dialogue._TAIL[s] // 2)) for s, (c, a) in best.items())
        steps = list(zip(run, states, states[1:], strict=False))
        tail = int(dialogue._TAIL[states[-1]])
        got = sum(int(dialogue._COST[c, a, b]) for c, a, b in steps) + tail
        assert (got, "".join(dialogue._EDITS[c][a][b] for c, a, b in steps) + "I" * (tail // 2)) == want


def test_memory_is_linear():
    """The peak over a run's rows grows with the rows alone: 8 bytes of state a row and some vectors."""
    peaks = []
    for size in (1 << 11, 1 << 13):
        run = bytes(random.Random(4).randrange(9) for _ in range(size))
        tracemalloc.start()
        dialogue.solve([run], np.zeros(1, np.int64), np.array([-1]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 200_000 + 12 * (1 << 13)


@pytest.mark.parametrize("block", [1024, 2, 3])
def test_repair_equals_brute_force(spark, block):
    """Blocks of two or three rows make every conversation a chain of them."""
    rows = made(7 + block)
    df = table(spark, rows).repartition(5)
    got = found(dialogue.Repair(df, block).summary(df))
    assert got == brute(rows, damaged=False)


def test_damaged_repair(spark):
    rows = made(3, convs=200)
    df = table(spark, rows)
    assert found(dialogue.Repair(dialogue.damaged(df)).summary(df)) == brute(rows)


def test_repaired_rows(spark):
    rows = made(5, convs=60)
    got = {}
    for r in dialogue.Repair(table(spark, rows), 4).rows().collect():
        got.setdefault(r["conv_id"], []).append((r["seq"], r["place"], r["line"], f"{r['role']}:{r['text']}"))
    for c in {r[0] for r in rows}:
        own = [(i, t, " " if r is None else r, " " if x is None else x) for i, t, r, x in rows if i == c]
        want = repair(own)[-1]
        assert [x[-1] for x in sorted(got.get(c, []))] == want
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in want))


def test_a_long_conversation_and_many_equal_rows(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "user"]), f"t{t}{rng.choice('.?x')}") for t in range(2500)]
    rows += [(2, 5, "user", "same.")] * 3000 + [(3, None, "assistant", "one.")]
    df = table(spark, rows)
    got = found(dialogue.Repair(df, 256).summary(df))
    assert got == brute(rows, damaged=False)
    assert got[2][6] == "K" + "D" * 2999 + "I"


def test_empty_and_gone(spark):
    none = table(spark, [])
    assert dialogue.Repair(none).summary(none).collect() == []
    ids = table(spark, [(4, 1, "user", "x")])
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(dialogue.Repair(none).summary(ids)) == {4: nothing}


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(dialogue.op12_conversation_repair(spark, d)) == brute(rows)


def test_sql_twin_equals_brute_force():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = made(11, convs=80)
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.execute(dialogue.OP12_SQL).fetchall()} == brute(rows)
