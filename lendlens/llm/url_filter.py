"""URL filter [native]: host rules first, else a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

The labelled table (:func:`labelled_urls`) is bounded by construction: every word
of two fixed lists under :data:`HOST_FORMS` and :data:`PATH_FORMS`, a few hundred
rows at any input size. Judging a URL is a projection of its row: no join, no
shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the contract: rule (host and path) and its verdict.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}

# Words of hosts, by label (1 = block).
BLOCKED_WORDS = (
    "casino-win casino-bonus online-casino free-bets best-bets sport-bets cheap-pills pills-shop buy-pills cheap-meds "
    "ads-track ad-tracker click-ads spam-farm spam-links link-farm adult-x adult-video xxx-cam porn-hub sex-chat "
    "win-prize free-prize lottery-win payday-loans fast-loans poker-room slots-king viagra-online replica-watch"
).split()
ALLOWED_WORDS = (
    "news weather library museum garden recipes science history travel school university hospital council theatre "
    "football cycling railway harbour village kitchen poetry painting physics biology chemistry geology reading "
    "writing thinking nothing another weather-map city-guide open-data book-club the-times in-depth on-air other "
    "thread thunder theory thing station nation election national tension herald render render-farm erosion order"
).split()
HOST_FORMS = ("{}.example.com", "www.{}.example.net", "m.{}.example.org", "blog.{}.example.com")
PATH_FORMS = ("/en/{}", "/page-{}.html")

#: Hash buckets of the n-grams and their lengths.
BUCKETS, GRAM_LENGTHS = 1 << 14, (3, 4, 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or where ``://`` is missing."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits the host or a domain above it and starts the path;
    rules of one length are taken in alphabetical order."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host$`` and of the path, digits read as one sign."""
    text = F.concat(F.lit("^"), host, F.lit("$"), F.regexp_replace(path, "[0-9]+", "0"))

    def of_length(n: int) -> Column:
        at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
        return F.coalesce(F.transform(at, lambda i: F.substring(text, i, F.lit(n))), F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_length(n) for n in GRAM_LENGTHS]))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled URL table: url, label (1 = block)."""
    def labelled(words: list[str], label: float) -> Column:
        return F.transform(
            F.split(F.lit(" ".join(words)), " "), lambda x: F.struct(x.alias("word"), F.lit(label).alias("label"))
        )

    words = F.concat(labelled(BLOCKED_WORDS, 1.0), labelled(ALLOWED_WORDS, 0.0))
    table = spark.range(1).select(F.explode(words).alias("w")).select("w.*")
    host = F.explode(F.array(*[F.lit(x) for x in HOST_FORMS]))
    path = F.explode(F.array(*[F.lit(x) for x in PATH_FORMS]))
    table = table.withColumn("host", host).withColumn("path", path)
    number = F.pmod(F.xxhash64("word", "host"), F.lit(900)).cast("string")
    return table.select(
        F.concat(
            F.lit("https://"), F.replace("host", F.lit("{}"), F.col("word")), F.replace("path", F.lit("{}"), number)
        ).alias("url"),
        "label",
    )


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """Logistic regression on the hashed n-grams of a labelled URL table."""
    rows = labelled.select(grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"), "label")
    hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(rows)
    return LogisticRegression(maxIter=40, regParam=0.01, standardization=False).fit(hashed.coalesce(1))


def judge(pages: DataFrame, labelled: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's block ``probability``.

    Input: columns page_id, url; others are ignored. A null url, or one without
    ``://``, has empty host and path, no rule, and is judged by the model like
    any other; repeated rows give repeated results.
    """
    model = train(labelled)
    rows = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules), "grams": grams(F.col("host"), F.col("path"))})
    hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(rows)
    verdict = reduce(lambda w, v: w.when(F.col("rule").isin([r for r in rules if rules[r] == v]), v), ("allow", "block"), F)
    judged = model.transform(hashed).withColumn("_p", vector_to_array("probability")[1])
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(verdict, F.when(F.col("_p") > 0.5, "block").otherwise("allow")).alias("verdict"),
        F.col("_p").alias("probability"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages", ["page_id", "url"]), labelled_urls(spark))
