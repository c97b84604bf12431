"""Test items near documents, against brute force and for any batch size."""

import pytest

from lendlens.llm import common, decontam
from .conftest import words
from .test_words import plain_words, rows_of


def brute_near(texts, items):
    """Items whose rarest words, by the documents that hold them, meet around the rarest one."""
    docs = {k: plain_words(t) for k, t in texts.items()}
    out = {k: set() for k in texts}
    for item, text in items:
        own = list(dict.fromkeys(plain_words(text)))
        df = {w: sum(w in d for d in docs.values()) for w in own}
        rare = sorted((w for w in own if df[w]), key=lambda w: df[w])[: decontam.NEAR_TERMS]
        if not own or len(rare) < min(decontam.NEAR_TERMS, len(own)):
            continue
        for k, d in docs.items():
            for i, x in enumerate(d):
                if x == rare[0] and set(rare) <= set(d[max(0, i - decontam.NEAR_SPAN) : i + decontam.NEAR_SPAN + 1]):
                    out[k].add(str(item))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def case():
    common_words = [f"c{i}" for i in range(30)]
    texts = {i: " ".join(common_words[i % 7 :] + words(40, i, 60)) for i in range(40)}
    texts[3] += " rare4 c1 rare2 c2 rare1 rare3 c3"  # close together, in another order
    texts[17] += " rare1 " + " ".join(words(40, 900, 60)) + " rare2 rare3 rare4"  # too far apart
    texts[28] += " rare3"
    texts[30] = ""
    items = [
        (1, "rare1 c1 c9 rare2 nowhere c4 rare3 elsewhere rare4"),  # two words that no document holds
        (2, "c1 c2 c3 c4 c5 rare3 c6"),
        (3, "unseen1 unseen2 unseen3 unseen4 rare1"),  # too few known words
        (4, "rare1 rare1"),
        (5, " ".join(words(12, 3, 60))),
        (6, ""),
    ]
    return texts, items


@pytest.mark.parametrize("rows", [1, 7, 1000])
@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 10])
def test_near_does_not_depend_on_batches(spark, case, monkeypatch, rows, block):
    monkeypatch.setattr(common, "BATCH_ROWS", rows)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    texts, items = case
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)
    found = decontam.search(decontam.build_index(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r["doc_id"]: r["near"] for r in rows_of(found)}
    assert got == brute_near(texts, items)
    assert "1" in got[3] and "1" not in got[17] and "3" not in got[3] and "4" in got[17]
