"""Line dedup against brute force: passages that repeat as one to three long lines,
random sequences of few lines, and what the winnowing stores."""

import random

import pytest

from lendlens.llm import line_dedup
from .conftest import words
from .test_words import rows_of


def brute(rows, run, long_words):
    """Deleted line numbers by doc_id: windows of ``run`` lines, or of fewer with more
    than ``long_words`` words, that occurred earlier."""
    first, out = {}, {}
    for k, text in sorted(rows):
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.split()]
        out[k] = set()
        for size in range(1, run + 1):
            for j in range(len(at) - size + 1):
                w = tuple(lines[i] for i in at[j : j + size])
                if size == run or sum(len(x.split()) for x in w) > long_words:
                    if first.setdefault(w, (k, at[j])) != (k, at[j]):
                        out[k].update(at[j : j + size])
    return out


def test_long_lines(spark):
    line = lambda n, seed: " ".join(words(n, seed))
    rows = [
        (1, f"{line(60, 1)}\nhead\n{line(30, 2)}\n \n{line(21, 3)}\nfoot\n{line(50, 4)}"),
        (2, line(60, 1)),  # one line of a document of one
        (3, f"x\n{line(30, 2)}\n{line(21, 3)}\ny"),  # two lines, 51 words together
        (4, f"z\n{line(50, 4)}\nq"),  # 50 words stay
        (5, f"{line(20, 5)}\n{line(20, 6)}\n{line(20, 7)}"),
        (6, f"a\n{line(20, 5)}\n{line(20, 6)}\n\n{line(20, 7)}\nb"),  # three lines
        (7, f"{line(60, 1)}\nv\n{line(60, 1)}"),  # twice in one document
        (8, "a\nb\nc\nd"),
        (9, "a\nb\nc\nd\n" + line(20, 5)),  # four short lines; a short single line stays
        (10, None),
        (11, ""),
    ]
    docs = spark.createDataFrame(rows + [rows[1]] * 3, "doc_id bigint, text string")  # repeated rows are one document
    want = brute(rows, line_dedup.RUN, line_dedup.LONG_WORDS)
    assert {k: sorted(v) for k, v in want.items() if v} == {2: [0], 3: [1, 2], 6: [1, 2, 4], 7: [0, 2], 9: [0, 1, 2, 3]}
    got = rows_of(line_dedup.delete_repeats(docs))
    assert len(got) == len(rows) + 3
    for r in got:
        lines, gone = (dict(rows)[r["doc_id"]] or "").split("\n"), want[r["doc_id"]]
        assert (r["text"] or "") == "\n".join(x for i, x in enumerate(lines) if i not in gone)
        assert (r["n_lines"], r["n_removed"]) == (len(lines), len(gone))
        assert r["n_runs"] == sum(i - 1 not in gone for i in gone)


@pytest.mark.parametrize(("run", "gram", "long_words"), [(4, 2, 50), (3, 1, 8), (2, 2, 12), (5, 3, 20), (4, 2, 1)])
def test_random_lines(spark, run, gram, long_words):
    """Few different lines of 1 to 30 words, so that runs repeat, overlap and tie in length."""
    rng = random.Random(run * 100 + long_words)
    pool = [" ".join(words(n, 200 + k)) for k, n in enumerate([1, 1, 2, 5, 5, 9, 17, 17, 30, 30])] + ["", " "]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randrange(12)))) for k in range(60)]
    want = brute(rows, run, long_words)
    got = rows_of(line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), run, gram, long_words))
    assert {r["doc_id"]: set(r["lines"]) for r in got} == {k: v for k, v in want.items() if v} and len(got) > 5


def test_without_long_runs(spark):
    """None leaves the lines alone to decide."""
    text = "\n".join(" ".join(words(40, 300 + k)) for k in range(3))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + "\nend"), (4, text + "\nend")], "doc_id bigint, text string")
    got = rows_of(line_dedup.repeated_lines(docs, long_words=None))
    assert [(r["doc_id"], r["lines"]) for r in got] == [(4, [0, 1, 2, 3])]


def test_selected_positions(spark):
    """Of short lines only the window minima are stored, about two thirds of all
    windows at most, and neighbouring windows share them."""
    text = "\n".join(" ".join(words(3, 400 + k)) for k in range(200))
    found = rows_of(line_dedup.fingerprints(spark.createDataFrame([(1, text)], "doc_id bigint, text string")))
    assert len(found) < 130 and sum(len(r["spans"]) for r in found) == 197
    assert all(r["lines"][r["at"]] == r["line"] for r in found)
