"""Quality rules, line dedup, near-dedup and decontamination against brute force."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lendlens.llm import decontam, line_dedup, minhash, quality

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_quality_base_counts(docs, texts):
    got = rows_of(quality.judge(docs))
    assert len(got) == docs.count()
    for r in got:
        text = texts[r["doc_id"] or 1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


@pytest.mark.parametrize("text", ["a b c d e a b c d e f", "a a a a a a", "a b a b a b a b", "x " * 5, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5"])
def test_repeated_words(spark, text):
    w = text.split()
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = len({j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(quality.repeated_words(quality.word_array(F.col("t")))).first()[0] == want


def test_quality_verdict(spark):
    """Clean documents stay, symbol and length outliers go, also in a small group."""
    good = [(i, " ".join(f"word{(i * 37 + j * 11) % 97}y" for j in range(80)), "en", "s") for i in range(60)]
    junk = [(100 + i, " ".join(f"wo{(i + j) % 71}%%%" for j in range(80)), "en", "s") for i in range(5)]
    junk += [(200, " ".join(f"{j}{'x' * 60}" for j in range(50)), "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in rows_of(quality.judge(spark.createDataFrame(good + junk, "doc_id bigint, text string, lang string, source string")))}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in (100, 101, 102, 103, 104, 200))


def test_quality_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    r = quality.op8_quality_rules(spark, d).join(labels, "doc_id").filter("NOT base_failed")
    n = {(x["quality"], x["kept"]): x["count"] for x in r.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)] and n.get((0, True), 0) <= 0.1 * n[(0, False)]


def brute_lines(rows, run=line_dedup.RUN, long_words=line_dedup.LONG_WORDS):
    """Deleted line numbers by (doc_id, text): runs of lines with a word that occurred
    earlier, of ``run`` lines or of fewer with more than ``long_words`` words."""
    first, out = {}, {}
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for size in range(1, run + 1):
            for i in range(len(at) - size + 1):
                w = tuple(lines[j] for j in at[i : i + size])
                if size == run or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in w) > long_words:
                    if first.setdefault(w, (k, text, i)) != (k, text, i):
                        gone.update(at[i : i + size])
        out[k, text] = gone
    return out


def test_line_dedup(spark, docs, texts):
    rows = [(None, texts[1]), *texts.items()]
    more = [(50, "a\nb\nc\nd\na\nb\nc\nd\ne"), (51, "z\n\na\nb\n \nc\nd\ne\nq"), (52, "p\n" * 9), (53, "p\np\np")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    want = brute_lines(rows + more)
    got = rows_of(line_dedup.delete_repeats(both.withColumn("n_lines", F.lit(1)).withColumn("_drop", F.lit(2))))
    assert len(got) == both.count()
    source = dict(rows + more)
    for r in got:
        text = source[r["doc_id"]]
        gone = want[r["doc_id"], text]
        lines = (text or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        assert (r["text"] or "") == kept and r["n_removed"] == len(gone) and r["n_lines"] == len(lines)
        assert r["n_runs"] == sum(i - 1 not in gone for i in gone) and r["_drop"] == 2
    assert sum(r["n_removed"] for r in got) > 20


def shingle_counts(text):
    w = plain_words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard_p(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a[k] / a[i], b[k] / b[i]) for k in every) for i in a if i in b)


def brute_classes(texts, similarity=0.8):
    sets = {k: shingle_counts(t) for k, t in texts.items()}
    root = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and set(sets[a]) & set(sets[b]) and jaccard_p(sets[a], sets[b]) >= similarity:
                x, y = sorted((root[a], root[b]))
                root = {k: x if r == y else r for k, r in root.items()}
    return root


def test_near_duplicates(docs, texts):
    got = rows_of(minhash.near_duplicates(docs))
    want = brute_classes(texts)
    assert len(got) == docs.count() and want[21] == 6 and want[22] == 7 and want[20] == 5 and want[31] == 31
    assert all(r["class_id"] == want[r["doc_id"] or 1] for r in got)


def test_near_duplicates_chain_and_blocks(spark, monkeypatch):
    """A chain of edits is one class; so it is when its group is cut into blocks."""
    monkeypatch.setattr(minhash, "GROUP_WORDS", 700)
    w, rows = [f"v{i}" for i in range(300)], []
    for i in range(8):
        w[10 + 35 * i] = f"new{i}"
        rows.append((i, " ".join(w)))
    texts = dict(rows) | {100: " ".join(f"q{i}" for i in range(200))}
    got = {r["doc_id"]: r["class_id"] for r in rows_of(minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))}
    assert got == brute_classes(texts) and got[7] == 0 and got[100] == 100


def test_prob_minhash_estimates_probability_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    value = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 5, 200).astype(float), rng.integers(1, 5, 200).astype(float)
    doc = np.repeat([0, 1], 200)
    registers = minhash.prob_minhash(doc, np.concatenate([value[:200], value[100:]]), np.concatenate([a, b]), 2, 4096)
    want = jaccard_p(collections.Counter(dict(enumerate(a))), collections.Counter({k + 100: x for k, x in enumerate(b)}))
    assert abs((registers[0] == registers[1]).mean() - want) < 0.04
    ab = minhash.probability_jaccard(a[100:], b[:100], a[:100].sum(), b[100:].sum())
    assert abs(ab - want) < 1e-9


def brute_hits(texts, items):
    out = {}
    for k, text in texts.items():
        w = plain_words(text)
        hit, found = set(), set()
        for item, t in items:
            p = plain_words(t)
            n = min(13, len(p))
            for i in range(len(p) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == p[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(item)
        ids = sorted(str(x) for x in found if x is not None) + [None] * (None in found)
        out[k] = (len(w), len(hit), ids, bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 30])
def test_decontamination(spark, docs, texts, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    six, twelve = plain_words(texts[6]), plain_words(texts[12])
    items = [(1, " ".join(six[10:40])), (2, "One, TWO three!"), (3, " ".join(twelve[5:18])), (4, None), (5, " .. "), (None, "w1x")]
    items += [(6, " ".join(six[20:30] + ["zzz"])), (7, "nothing like this is found anywhere"), (1, " ".join(six[38:55])), (10, six[3])]
    items += [(None, " ".join(twelve[30:50])), (None, " ".join(twelve[40:60]))]  # without an id: one item
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    small = {k: t for k, t in texts.items() if k != 40}
    got = rows_of(decontam.judge(docs.filter("doc_id <> 40 OR doc_id IS NULL"), bench))
    want = brute_hits(small, items)
    assert any(None in w[2] for w in want.values())
    assert len(got) == docs.count() - 1
    for r in got:
        k = r["doc_id"] or 1
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == want[k], k
        assert r["n_items"] == len(r["items"]) and None not in r["near"]
        assert not set(r["items"]) - {"2", "10", None} - set(r["near"])
    left = decontam.build_index(docs.limit(0))
    assert decontam.search(left, bench).count() == 0
    none = rows_of(decontam.judge(docs.filter("doc_id = 6"), bench.limit(0)))
    assert none[0]["n_hit"] == 0 and not none[0]["contaminated"]


def test_empty_tables(empty):
    assert quality.judge(empty).count() == 0
    assert line_dedup.delete_repeats(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0


def test_kept_hash_matches_text(docs):
    r = line_dedup.delete_repeats(docs).select("text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()
    assert all(x["h"] == hashlib.sha256((x["text"] or "").encode()).hexdigest() for x in r)
