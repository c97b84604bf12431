"""Line dedup [native]: winnowing over line hashes.

A document's lines with a word, in order, form a sequence of line hashes. A run of
consecutive lines counts if it has :data:`RUN` lines or more, or more than
:data:`LONG_WORDS` words; every line of a counting run that also occurred earlier
(by doc_id, then line) is deleted.

Guaranteed fingerprints: in every window of RUN lines the smallest hash of its
:data:`GRAM`-line grams is selected (winnowing), so equal runs of RUN lines always
share one; a counting run of fewer lines selects its longest line. Only the
selected positions are stored and shuffled, each with the few line hashes around it.
Positions are joined by fingerprint; where one begins in two places, each is
extended to the left and right over the line hashes, to every counting run it was
selected for. A run's earliest place stays, later ones mark their lines, and the
marked lines of a document join to its maximal repeated runs.

Shuffled rows are of fixed size and combined map-side before they move, so a passage
in a third of all documents is one small row a task. Both joins have one row a key
on one side, so a hot key can be split. No pair of documents is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Lines of the shortest run that counts whatever its words, and lines of a fingerprint.
RUN, GRAM = 4, 2
#: A run of fewer lines counts if it has more words than this.
LONG_WORDS = 50


def _sequence() -> Column:
    """Line numbers ``i``, hashes ``h`` and word counts ``n`` of the lines with a word."""

    def line(x: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(common.WORD_PATTERN)).alias("n"))

    return F.filter(F.transform(F.split(F.col("_text"), "\n"), line), lambda x: x["n"] > 0)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _position(s: Column, p: Column, mark: Column, spans: Column, reach: int) -> Column:
    """A selected position: its fingerprint, where it begins, the lines from ``reach``
    before to ``reach`` after it, and the spans (lines to the left, to the right) of its runs."""
    start = F.greatest(p - reach, F.lit(0))
    around = F.slice(s, start + 1, p - start + reach + 1)
    return F.struct(
        mark.alias("mark"), F.get(s, p)["i"].alias("line"), (p - start).alias("at"),
        F.transform(around, lambda x: x["i"]).alias("lines"), F.transform(around, lambda x: x["h"]).alias("hashes"),
        spans.alias("spans"),
    )


def _minima(s: Column, run: int, gram: int) -> Column:
    """The winnowing minima of the windows of ``run`` lines (leftmost among equals)."""
    grams = run - gram + 1

    def selected(best: Column) -> Column:
        def position(p: Column) -> Column:
            # the windows that chose p begin up to grams - 1 lines before it
            lefts = F.filter(F.sequence(F.lit(0), F.lit(grams - 1)), lambda k: F.get(best, p - k)["p"] == p)
            spans = F.transform(lefts, lambda k: F.struct(k.alias("left"), (run - 1 - k).alias("right")))
            return _position(s, p, F.xxhash64(*[F.get(s, p + k)["h"] for k in range(gram)]), spans, run - 1)

        return F.transform(F.array_distinct(F.transform(best, lambda x: x["p"])), position)

    def least(marks: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - run)
        choices = lambda i: [F.get(marks, i + k) for k in range(grams)]
        return _let(F.transform(at, lambda i: F.least(*choices(i)) if grams > 1 else choices(i)[0]), selected)

    def mark(i: Column) -> Column:
        return F.struct(F.xxhash64(*[F.get(s, i + k)["h"] for k in range(gram)]).alias("m"), i.alias("p"))

    return F.when(F.size(s) >= run, _let(F.transform(F.sequence(F.lit(0), F.size(s) - gram), mark), least))


def _long_lines(s: Column, run: int, long_words: int) -> Column:
    """The longest line (leftmost among equals) of each run of fewer than ``run`` lines
    with more than ``long_words`` words."""
    shapes = [(k, size - 1 - k) for size in range(1, run) for k in range(size)]

    def position(x: Column, p: Column) -> Column:
        def words(k: int) -> Column:
            return F.get(s, p + k)["n"]

        spans = []
        for left, right in shapes:
            # a line beyond either end gives null words, and no run
            longest = [words(-k) < x["n"] for k in range(1, left + 1)] + [words(k) <= x["n"] for k in range(1, right + 1)]
            fits = sum((words(k) for k in range(-left, right + 1)), F.lit(0)) > long_words
            for test in longest:
                fits = fits & test
            spans.append(F.when(fits, F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"))))
        return _position(s, p, F.xxhash64(F.lit(1), x["h"]), F.array_compact(F.array(*spans)), run - 2)

    # the longest of up to run - 1 lines has at least its share of the words
    share = long_words // (run - 1)
    found = F.transform(s, lambda x, p: F.when(x["n"] > share, position(x, p)))
    return F.filter(found, lambda x: F.size(x["spans"]) > 0)


def fingerprints(docs: DataFrame, run: int = RUN, gram: int = GRAM, long_words: int | None = LONG_WORDS) -> DataFrame:
    """A row for each selected position: doc_id and text hash, the fingerprint ``mark``
    and the number of the ``line`` it begins in, the line numbers and hashes around it (its own at
    index ``at``) and the spans of the runs that selected it."""

    def selected(s: Column) -> Column:
        found = F.coalesce(_minima(s, run, gram), F.array())
        return found if long_words is None or run < 2 else F.concat(found, _long_lines(s, run, long_words))

    return (
        docs.select("doc_id", common.text_or_empty("text").alias("_text"))
        .select("doc_id", F.xxhash64("_text").alias("text_hash"), F.explode(_let(_sequence(), selected)).alias("x"))
        .select("doc_id", "text_hash", "x.*")
    )


def _extended(near: DataFrame) -> DataFrame:
    """Each position extended both ways to the runs it was selected for: their line
    numbers and the 128-bit hash (``a``, ``b``) of their lines."""
    at, size = F.col("at") - F.col("span.left") + 1, F.col("span.left") + F.col("span.right") + 1
    runs = near.withColumn("span", F.explode("spans")).select(
        "doc_id", "text_hash", F.slice("lines", at, size).alias("lines"), F.slice("hashes", at, size).alias("_h")
    )
    return runs.select(
        "doc_id", "text_hash", "lines", F.xxhash64("_h").alias("a"), F.xxhash64(F.size("_h"), F.reverse("_h")).alias("b")
    )


def repeated_lines(docs: DataFrame, run: int = RUN, gram: int = GRAM, long_words: int | None = LONG_WORDS) -> DataFrame:
    """doc_id, text_hash and ``lines``, the numbers of the lines to delete. Rows of
    equal doc_id and text are one document."""
    found = common.stage(fingerprints(docs, run, gram, long_words), "fingerprints")
    # a fingerprint is shared if it begins in two places
    begins = F.struct(F.col("doc_id"), F.col("text_hash"), F.col("line"))
    shared = found.groupBy("mark").agg(F.min(begins).alias("first"), F.max(begins).alias("last"))
    shared = shared.filter("first <> last").select(F.col("mark").alias("m"))
    runs = _extended(found.join(shared, F.col("mark") == F.col("m"), "left_semi"))
    place = F.struct(F.col("doc_id"), F.col("text_hash"), F.col("lines")[0].alias("line"))
    first = (
        runs.groupBy("a", "b")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first")
    )
    later = runs.join(first, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).filter(place != F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("lines")
    )


def delete_repeats(docs: DataFrame, run: int = RUN, gram: int = GRAM, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` with the lines of later repeated runs (of ``run`` lines
    or more, or of more than ``long_words`` words; None: lines alone decide) deleted from ``text``, and the counts ``n_lines``,
    ``n_removed`` (lines) and ``n_runs`` (deleted runs of neighbouring line numbers).

    Input: columns doc_id and text; others are kept, but for those named like a
    count, which are replaced. A null text stays null and
    has no line with a word; lines without a word are never deleted; a null
    doc_id comes before all others; a document may lose all its lines.
    """
    drop = repeated_lines(docs, run, gram, long_words).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lines").alias("_drop")
    )
    text = common.text_or_empty("text")
    joined = docs.join(drop, docs["doc_id"].eqNullSafe(drop["_id"]) & (F.xxhash64(text) == drop["_hash"]), "left")
    gone = drop["_drop"]

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    cut = F.transform(F.array(F.split(text, "\n")), rest)[0]
    starts = F.filter(F.transform(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) != x - 1)), lambda x: x)
    counts = {
        "n_lines": F.size(F.split(text, "\n")).cast("long"),
        "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        "n_runs": F.when(gone.isNull(), 0).otherwise(F.size(starts)).cast("long"),
    }
    text = F.when(gone.isNull(), docs["text"]).otherwise(cut).alias("text")
    return joined.select(
        *[text if c == "text" else docs[c] for c in docs.columns if c not in counts],
        *[value.alias(name) for name, value in counts.items()],
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = delete_repeats(common.read(spark, sf_dir, "documents", ["doc_id", "text"]))
    kept = F.sha2(common.text_or_empty("text"), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", kept)


# windows of fewer than RUN lines count with more than LONG_WORDS words; longer runs are covered by those of RUN lines
_SIZED = "\n  UNION ALL BY NAME ".join(
    f"""SELECT doc_id, line, p, {m} AS size, list(t) OVER x AS w, sum(n) OVER x AS n FROM worded
    WINDOW x AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)"""
    for m in range(1, RUN + 1)
)
OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, string_split(coalesce(text, ''), chr(10))[i] AS t
  FROM documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS u(i)
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS p, len(regexp_extract_all(t, '{common.WORD_PATTERN}')) AS n
  FROM lines WHERE regexp_matches(t, '{common.WORD_PATTERN}')
), windows AS (
  {_SIZED}
), later AS (
  SELECT doc_id, p, size FROM (
    SELECT doc_id, p, size, row_number() OVER (PARTITION BY w ORDER BY doc_id, line) AS k
    FROM windows WHERE len(w) = size AND (size = {RUN} OR n > {LONG_WORDS})
  ) WHERE k > 1
), dropped AS (
  SELECT DISTINCT x.doc_id, x.line FROM worded x JOIN later y
  ON x.doc_id = y.doc_id AND x.p BETWEEN y.p AND y.p + y.size - 1
), marked AS (
  SELECT l.*, d.line IS NOT NULL AS gone FROM lines l LEFT JOIN dropped d ON l.doc_id = d.doc_id AND l.line = d.line
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line), false) AS starts FROM marked
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs,
  sha256(coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
FROM edges GROUP BY doc_id
"""


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without the lines of later repeated runs; one
    that loses its last word so goes (all its lines stand in earlier places). n_chars tells the new length."""
    named = docs.select(*[docs[c].alias(f"{c}__" if c in ("n_lines", "n_removed", "n_runs") else c) for c in docs.columns])
    out = delete_repeats(named)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(common.WORD_PATTERN))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(n).alias(c) for n, c in zip(named.columns, docs.columns, strict=True)])
