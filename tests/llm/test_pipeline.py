"""The pipeline's stages, each against brute force on its own input."""

import pytest

import corpus_pipeline
from lendlens.llm import minhash, sp_codec
from .test_words import brute_classes, brute_hits, brute_lines, plain_words, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, apply in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        apply(spark, docs, FOLDER).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((docs, result))
        docs = result
    return out


def as_dict(df):
    return {r["doc_id"]: r["text"] for r in rows_of(df)}


def test_columns(steps):
    for docs, result in steps[:-1]:
        assert result.columns == docs.columns and dict(result.dtypes) == dict(docs.dtypes)


def test_quality_rules(steps, spark):
    before, after = as_dict(steps[0][0]), as_dict(steps[0][1])
    labels = {r["doc_id"]: r["quality"] for r in rows_of(spark.read.parquet(f"{FOLDER}/labels.parquet"))}
    assert all(after[k] == before[k] for k in after) and 0.5 * len(before) < len(after) < len(before)
    assert sum(labels.get(k) == 0 for k in after) <= 0.05 * len(after)


def test_line_dedup(steps):
    before, after = as_dict(steps[1][0]), as_dict(steps[1][1])
    gone = brute_lines(before.items())
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k, t]) for k, t in before.items()}
    assert after == {k: t for k, t in want.items() if t.strip() or not gone[k, before[k]]} and len(after) < len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in rows_of(steps[1][1]))


def test_near_dedup(steps):
    before, after = as_dict(steps[2][0]), as_dict(steps[2][1])
    first = {}
    for k in sorted(k for k, t in before.items() if not plain_words(t)):
        first.setdefault("".join((before[k] or "").split()), k)
    assert after == {
        k: before[k] for k, root in brute_classes(before).items() if (k == root if plain_words(before[k]) else k in first.values())
    }


def test_emptied_copies_leave_one_row(spark):
    rows = [(i, t, "en", "s", 0) for i, t in [(9, ""), (3, " \n"), (5, None), (4, "..."), (8, ". . ."), (7, "a word"), (2, "--"), (9, "")]]
    got = minhash.first_of_each(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), FOLDER)
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 3, 4, 7]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_any_rows(spark, docs, empty, stage):
    """Null, empty, very long and repeated texts, a row without id, clashing columns; an empty table."""
    name, apply = corpus_pipeline.STAGES[stage]
    got = apply(spark, docs, FOLDER)
    assert apply(spark, empty, FOLDER).collect() == []
    if stage < 4:
        assert got.columns == docs.columns
        assert {r["doc_id"] for r in got.collect()} <= {r["doc_id"] for r in docs.collect()}
    else:
        assert got.count() == docs.count()


def test_decontamination(steps, spark):
    before, after = as_dict(steps[3][0]), as_dict(steps[3][1])
    items = [(r["item_id"], r["text"]) for r in rows_of(spark.read.parquet(f"{FOLDER}/benchmark.parquet"))]
    grams = {tuple(w[i : i + 3]) for w in map(str.split, (t for _, t in items)) for i in range(len(w))}
    near = {k: t for k, t in before.items() if any(tuple(x) in grams for x in zip(t.split(), t.split()[1:], t.split()[2:], strict=False))}
    bad = {k for k, x in brute_hits(near, items).items() if x[3]}
    assert set(after) == set(before) - bad


def test_sentencepiece(steps):
    library = sp_codec.vocabulary_of(sp_codec.default_model()).library
    before, after = as_dict(steps[4][0]), {r["doc_id"]: r for r in rows_of(steps[4][1])}
    assert set(before) == set(after)
    assert all(after[k]["n_tokens"] == len(library.encode(t)) for k, t in before.items())


def test_run_equals_stages(steps, spark):
    key = lambda r: r["doc_id"]
    assert sorted(rows_of(corpus_pipeline.run(spark, FOLDER)), key=key) == sorted(rows_of(steps[-1][1]), key=key)


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names
