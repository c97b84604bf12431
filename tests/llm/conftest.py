import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, key string, _id bigint, n_lines int"


def words(n, seed, size=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}x" for _ in range(n)]


def prose(n, seed, line=12):
    w = words(n, seed)
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


@pytest.fixture(scope="session")
def texts():
    """Clean texts, near and exact copies, shared passages, nulls, empties, a very long one, repeated rows."""
    out = {i: prose(60 + 7 * i, i) for i in range(1, 13)}
    out[20] = out[5]  # an exact copy
    out[21] = out[6].replace(out[6].split()[30], "changed")  # a near copy
    out[22] = out[7] + "\nand one more line here"
    out[23] = prose(100, 99) + "\n" + prose(80, 500) + "\n" + prose(50, 98)  # a shared passage
    out[24] = prose(70, 97) + "\n" + prose(80, 500)
    out[30], out[31], out[32] = None, "", " \n\t "
    out[33] = "one two three"
    out[40] = prose(30000, 77)
    out[41] = "é" * 50 + " ñandú " + "x" * 5000
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, ["en", None, "de"][k % 3], f"s{k % 2}", len(t or ""), k, "k", 1, 7) for k, t in texts.items()]
    rows += [rows[0], (None, *rows[0][1:])]  # a repeated row, and one without doc_id
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
