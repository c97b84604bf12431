"""Steps whose cost per row must not grow with the table: numbering, text embeddings, stored stages."""

import re

import pytest
from pyspark.sql import functions as F

from lendlens.functions.exprs import round_doubles
from lendlens.operators import clusters, embed, features, pairs
from lendlens.operators.ids import number_within
from lendlens.plans import queries
from lendlens.plans.pipeline import stages_to_store
from lendlens.sources.adapter import lender_rows, raw_applications
from tests.test_pairs import synthetic

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_groups_are_numbered_without_a_table_of_chunks(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("g"), (F.col("id") * 50).alias("k"))
    out = number_within(df, "g", "k", "n", chunk_width=64)
    assert "Join" not in optimized(out) and out.count() == 3000
    assert out.where(F.col("n") != F.floor(F.col("k") / 50 / 700) + 1).count() == 0


@pytest.mark.parametrize("hashed", [False, True])
def test_hot_groups_are_numbered_in_chunks(spark, hashed):
    key = F.xxhash64("id") if hashed else F.col("id")
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 != 0, F.concat(F.lit("g"), F.col("id") % 40))
    df = spark.range(4000).select(group.alias("g"), key.alias("k"), "id")
    out = number_within(df, "g", "k", "n", chunk_width=64, hashed_key=hashed, hashed_chunk_bits=6, hot_rows=500)
    assert "Join" in optimized(out) and out.columns == ["g", "k", "id", "n"] and dict(out.dtypes)["n"] == "bigint"
    got = {r.id: r.n for r in out.collect()}
    groups = {}
    for r in df.where("g IS NOT NULL").collect():
        groups.setdefault(r.g, []).append((r.k, r.id))
    assert got == {i: n for rows in groups.values() for n, (_, i) in enumerate(sorted(rows), 1)}


def test_vectors_of_texts_with_ids_of_their_own_need_no_shuffle(spark):
    texts = ["Loan amount: $250K. loan LOAN", None, "", " .. ", "a b c " * 200, "Zürich K9\nx"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    out = embed.hash_embedding_sparse(df, "id", "t", dim=16, unique_ids=True)
    assert "Aggregate" not in optimized(out) and "Window" not in optimized(out)

    def rows(x):
        return sorted((r.id, r.slot, r.value) for r in x.collect())

    assert rows(out) == rows(embed.hash_embedding_sparse(df, "id", "t", dim=16)) and out.count() > 0
    dense = {r.id: r.v for r in df.select("id", embed.hash_embedding(F.col("t"), 16).alias("v")).collect()}
    assert dense[1] is None and dense[2] == dense[3] == [0.0] * 16
    assert df.where("t IS NULL").select(embed.hash_embedding(F.col("t"), 16).alias("v")).collect()[0].v is None


def test_filters_compute_no_digests(spark):
    raw = raw_applications(spark, SF).where("action_taken = 1 AND rate_spread <> 'NA' AND income <> 'NA' AND applicant_race_1 = 5")
    assert not re.search(r"Filter[^\n]*md5", optimized(raw))


@pytest.mark.parametrize("name", ["similar_pairs", "grid_clusters", "compliance_report"])
def test_stored_applications_hold_no_texts_and_vectors(spark, name):
    stored = queries._pipe(spark, SF, name).embedded
    assert not {"profile_text", "profile_embedding"} & set(stored.columns) and stored.count() > 0


@pytest.mark.parametrize("name,stage", [("text_similar_pairs", "text_embedded"), ("cosine_distance_pairs", "financial")])
def test_pair_searches_read_stored_applications(name, stage):
    assert stage in stages_to_store(queries.QUERY_STAGES[name])


def test_token_encoding_takes_bounded_chunks_of_a_batch(monkeypatch):
    """One Arrow batch may hold megabytes: its rows are encoded in chunks, in order and none lost."""
    import pyarrow as pa

    from lendlens.llm import token_files

    monkeypatch.setattr(token_files, "CHUNK_POINTS", 10)
    texts = ["", "abcd", "efghij", "k", "x" * 25, "", "yz", "Zürich", "abc"]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 9)], pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    found = list(token_files.chunks(iter([batch, batch.slice(0, 0), batch.slice(0, 2)])))
    assert [x for ids, _ in found for x in ids] == [None, *range(1, 9), None, 1]
    assert [t for _, part in found for t in part] == texts + texts[:2]
    assert all(len(part) == 1 or sum(map(len, part)) <= 10 for _, part in found) and len(found) == 6


def test_stored_applications_put_no_text_together(spark):
    """Whether the profile text is there is told from its parts, and parts that a key implies aren't derived."""
    plan = optimized(queries._pipe(spark, SF, "dashboard").profiles.where(features.has_profile_text()).select("application_id", "income"))
    assert "Mortgage application" not in plan and "Multifamily" not in plan
    rows = [("a", 1.0), (None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "race_category string, income double")
    for name in features.PROFILE_TEXT_PARTS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(1.0))
    df = df.withColumns({"rate_spread": F.lit(None).cast("double"), "approved": F.lit(None).cast("boolean"), "denial_reason_1": F.lit(1)})
    got = df.select(features.has_profile_text().alias("there"), features.profile_text().isNotNull().alias("text")).collect()
    assert [r.there for r in got] == [r.text for r in got] == [True, False, False]


def test_lenders_are_sized_from_two_columns(spark):
    """The bound on a lender's rows reads no customers and derives no digests; numbers don't depend on it."""
    plan = optimized(lender_rows(spark, SF))
    assert "md5" not in plan and "c_custkey" not in plan
    df = spark.range(600).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    few, many = (df.where("g = 0"), df.unionAll(df))
    plain = {r.k: r.n for r in number_within(df, "g", "k", "n", chunk_width=16).collect()}
    for sizes in (few, many):
        assert {r.k: r.n for r in number_within(df, "g", "k", "n", chunk_width=16, hot_rows=150, sizes=sizes).collect()} == plain


def test_keyed_applications_are_the_raw_ones_with_a_key(spark):
    raw, keyed = (raw_applications(spark, SF, keyed=k).where("source_key IS NOT NULL") for k in (False, True))
    assert raw.exceptAll(keyed).count() == keyed.exceptAll(raw).count() == 0 and keyed.count() > 0


def test_short_vectors_go_along_with_the_pair_join(spark):
    """Pairs within the distance are found by one join; a long vector is fetched by id, with the same pairs."""
    apps = queries._pipe(spark, SF, "similar_pairs").embedded
    short, fetched = (pairs.similar_pairs(apps, vector_dim=d) for d in (embed.FINANCIAL_DIM, None))
    assert optimized(short).count("Join") == 1 and optimized(fetched).count("Join") == 3
    assert short.exceptAll(fetched).count() == fetched.exceptAll(short).count() == 0


def test_new_pre_tokens_are_asked_in_bounded_parts(monkeypatch):
    from lendlens.llm import token_files

    monkeypatch.setattr(token_files, "ASKED", 3)
    encoder = token_files.PreTokens(token_files.default_tokenizer())
    whole, sizes = encoder.library, []

    class Counted:
        def encode_batch_fast(self, part, **kw):
            sizes.append(len(part))
            return whole.encode_batch_fast(part, **kw)

    encoder.library = Counted()
    text = "one two three four five six seven eightynine it's"
    ids, at = encoder.encode_batch([text, ""])
    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids and at.tolist() == [0, len(ids), len(ids)]
    assert max(sizes) <= 3 and sum(sizes) >= 9


@pytest.mark.parametrize("name", ["similar_pairs_both_directions", "similar_pairs"])
def test_pair_queries_find_the_financial_columns(spark, name):
    """The stored applications of a query without clusters keep what the pair search reads."""
    assert queries.spark_query(name)(spark, SF).count() > 0


@pytest.mark.parametrize("dim", [4, None])
@pytest.mark.parametrize("both", [False, True])
def test_fewer_cells_lose_no_pair(spark, monkeypatch, dim, both):
    """Blocks of several sizes: cells for income alone, with loan, with DTI, and cells that are searched."""
    emb = synthetic(spark, 500, 5).withColumn("lei", F.when(F.col("income") > 150, "L9").otherwise(F.col("lei"))).cache()

    def rows(cell_rows, **kw):
        monkeypatch.setattr(pairs, "CELL_ROWS", cell_rows)
        return sorted(tuple(r) for r in pairs.similar_pairs(emb, vector_dim=dim, both_directions=both, **kw).collect())

    want = rows({"_cl": 0, "_cd": 0})
    for cell_rows, kw in (({"_cl": 0, "_cd": 10**6}, {}), ({"_cl": 10**6, "_cd": 10**6}, {}), ({"_cl": 0, "_cd": 10**6}, {"heavy_cell": 9})):
        assert want and want == rows(cell_rows, **kw)


def test_top_pairs_are_found_without_moving_the_pairs(spark):
    apps = queries._pipe(spark, SF, "similar_pairs").embedded
    plan = pairs.similar_pairs(apps, vector_dim=embed.FINANCIAL_DIM)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("hashpartitioning(base_app_id" in line for line in exchanges)


def test_kept_cells_go_to_all_tasks_or_meet_under_salted_keys(spark, monkeypatch):
    """The applications aren't moved to meet a small table of cells; a large one gives the same rows."""
    apps = queries._pipe(spark, SF, "grid_clusters").embedded
    few = clusters.grid_clusters(apps, min_size=2)
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString() and few.count() > 0
    monkeypatch.setattr(clusters, "FEW_CELLS", 0)
    many = clusters.grid_clusters(apps, min_size=2)
    assert "_salt" in optimized(many)
    key = lambda df: sorted(tuple(map(str, r)) for r in round_doubles(df, 9).collect())
    assert key(few) == key(many)


def test_assessment_meets_stored_statistics(spark):
    """The violations aren't shuffled to meet one row a lender and state."""
    plan = queries.spark_query("explanations")(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
