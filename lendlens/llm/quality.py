"""Quality rules [native]: base rules on each document, then robust multivariate
outliers within each language and source.

Base statistics come from built-in array functions over one row, so no row is
shuffled for them. The verdict fits, for every (lang, source), a
minimum-covariance-determinant estimate of location and scatter of four
transformed statistics by concentration steps: start from median and spread,
keep the half with the smallest distances, refit, repeat. Each step is one
partial aggregate per group (group sums, an approximate quantile of distances),
so a group holding a third of all rows is still combined map-side and no group
meets in one task. A document is rejected when its squared Mahalanobis distance
in the direction of junk exceeds ``cutoff``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
#: Transformed statistics of the robust fit.
FEATURES = ("f_length", "f_symbols", "f_repeats", "f_lines")
#: Least standard deviation of each statistic: spreads under it are taken for
#: exact agreement, not for evidence (most documents have no symbol at all).
FLOORS = (0.10, 0.06, 0.12, 0.12)
#: Share of each group that the determinant criterion keeps, concentration steps,
#: and the squared distance beyond which a document goes.
KEEP_SHARE, STEPS, CUTOFF = 0.75, 3, 60.0
#: Parts into which every group's rows are dealt when they meet their model.
SALTS = 64


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """Bind ``value`` once as a lambda variable, so that it is computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words that lie in a ``size``-word window found twice or more in the text.

    Windows are compared by a 64-bit hash. A text whose windows are all distinct
    (a hash set tells) is done at once; the others sort (hash, position).
    """

    def cover(positions: Column) -> Column:
        # each position covers `size` words, less what the one before covered
        steps = F.transform(
            positions,
            lambda p, i: F.when(i == 0, F.lit(size)).otherwise(F.least(F.lit(size), p - positions[i - 1])),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(grams: Column) -> Column:
        def repeated(pairs: Column) -> Column:
            hit = F.filter(
                F.transform(
                    pairs,
                    lambda p, i: F.when(
                        (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]), p["i"]
                    ),
                ),
                lambda x: x.isNotNull(),
            )
            return _let(F.sort_array(hit), cover)

        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
            _let(pairs, repeated)
        )

    def of_words(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
        )
        return F.when(F.size(w) <= size, F.lit(0).cast("long")).otherwise(_let(grams, count))

    return _let(words, of_words)


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash and the base statistics of every whole text. A
    null or empty text has no words and all counts 0."""
    text = common.text_or_empty("text")
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = docs.select("doc_id", "lang", "source", text.alias("_t")).select(
        "doc_id",
        "lang",
        "source",
        F.xxhash64("_t").alias("text_hash"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.split("_t", "\n")).alias("_lines"),
        _let(
            word_array(F.col("_t")),
            lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")),
        ).alias("_w"),
    )
    return counted.select(
        "doc_id",
        "lang",
        "source",
        "text_hash",
        F.col("_w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("_w.r").alias("n_repeat_words"),
        "_lines",
    ).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def statistic_vector(stats: DataFrame) -> DataFrame:
    """Transformed statistics: log word length, and square roots (which level the
    spread of shares) of symbols per word, repeated words and repeated lines."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "f_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            "f_symbols": F.sqrt(F.col("n_symbols") / n),
            "f_repeats": F.sqrt(F.col("n_repeat_words") / n),
            "f_lines": F.sqrt(F.col("n_dup_lines") / F.col("_lines")),
        }
    )


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, f in enumerate(FEATURES):
        inner = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * z[k], range(i), F.col(f) - F.col(f"m_{i}"))
        z.append(inner / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, x: a + x * x, z, F.lit(0.0))


def _fit(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and Cholesky factor of each group's rows: one partial aggregate."""
    p = len(FEATURES)
    sums = [F.avg(f).alias(f"m_{i}") for i, f in enumerate(FEATURES)]
    prods = [F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)]
    moments = vectors.groupBy(*keys).agg(*sums, *prods)
    var = lambda i, j: F.col(f"s_{max(i, j)}_{min(i, j)}") - F.col(f"m_{i}") * F.col(f"m_{j}")
    for j in range(p):  # one projection a column: later entries use earlier ones by name
        diag = F.greatest(var(j, j), F.lit(0.0)) + F.lit(FLOORS[j] ** 2)
        inner = reduce(lambda a, k: a - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}"), range(j), diag)
        moments = moments.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(inner, F.lit((FLOORS[j] / 4) ** 2))))
        for i in range(j + 1, p):
            inner = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), var(i, j))
            moments = moments.withColumn(f"l_{i}_{j}", inner / F.col(f"l_{j}_{j}"))
    chol = [f"l_{i}_{j}" for i in range(p) for j in range(i + 1)]
    return moments.select(*keys, *[f"m_{i}" for i in range(p)], *chol)


def _start(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Median and scaled quartile range of each statistic: a robust start."""
    p = len(FEATURES)
    out = vectors.groupBy(*keys).agg(
        *[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, f in enumerate(FEATURES)]
    )
    cols = [F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)]
    for i in range(p):
        spread = (F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / F.lit(1.349)
        for j in range(i + 1):
            cols.append((F.sqrt(spread**2 + F.lit(FLOORS[i] ** 2)) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}"))
    return out.select(*keys, *cols)


def robust_distances(vectors: DataFrame, keep: float = KEEP_SHARE, steps: int = STEPS) -> DataFrame:
    """``vectors`` with ``distance``: each row's squared Mahalanobis distance from
    its group's minimum-covariance-determinant estimate. Null lang or source
    form groups of their own."""
    keys = ["_lang", "_source"]
    vectors = vectors.withColumns(
        {k: F.coalesce(F.concat(F.lit("="), F.col(k[1:]).cast("string")), F.lit("null")) for k in keys}
        | {"_salt": F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(SALTS))}
    )

    def meet(rows: DataFrame, per_group: DataFrame) -> DataFrame:
        salted = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return rows.join(salted, [*keys, "_salt"])

    model = _start(vectors, keys)
    for _ in range(steps):
        near = meet(vectors, model).select(*keys, "_salt", *FEATURES, _distance().alias("distance"))
        limit = near.groupBy(*keys).agg(F.percentile_approx("distance", keep, 1000).alias("_limit"))
        inside = meet(near, limit).filter("distance <= _limit").select(*keys, *FEATURES)
        model = common.stage(_fit(inside, keys), "mcd")
    return meet(vectors, model).withColumn("distance", _distance())


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, text_hash, the base statistics, ``base_failed``, ``distance`` and ``kept``.

    Input: columns doc_id, text, lang, source; others are ignored. Null or
    empty texts fail the base rules; repeated rows give repeated results; an
    empty table gives an empty result.
    """
    stats = common.stage(statistic_vector(base_statistics(docs)), "quality")
    # documents that fail the base rules are out already and shape no estimate
    passed = stats.filter(~F.col("base_failed"))
    scored = robust_distances(passed).select(*stats.columns, "distance")
    failed = stats.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    return scored.unionByName(failed).withColumn(
        "kept", F.coalesce(~F.col("base_failed") & (F.col("distance") <= cutoff), F.lit(False))
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the quality rules keep, unchanged."""
    good = judge(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(good["_id"]) & (F.xxhash64(common.text_or_empty("text")) == good["_hash"])
    return docs.join(good, same, "left_semi")
