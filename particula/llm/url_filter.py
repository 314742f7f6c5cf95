"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams of host and path for the rest.

Method, with DataFrame functions and ``pyspark.ml`` only. Host and path are cut
from the url by SQL expressions. A small labelled URL table (a parameter; each
row is a url and 1 for block) is turned into hashed counts of character n-grams
of ``^host$`` and ``^path$`` and fitted by a ridge logistic regression. Its
``2**BITS`` coefficients are all that a task needs to judge a row, in one pass
without a shuffle; a url is blocked from a probability of ``THRESHOLD`` on.

A rule fits its host and all subdomains if the path starts with the rule's;
the longest rule wins and overrules the regression.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no rule, and its verdict is the regression's on empty strings; repeated
rows are judged one by one; an empty table gives no rows; other columns are
ignored; an unlabelled or null training url is skipped.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
GRAMS = (3, 4, 5)
THRESHOLD = 0.5

# Verdict, host and path of the rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

# A small labelled URL table, 1 for block.
LABELLED = (
    ("https://adult-videos.example.com/en/1/", 1),
    ("http://www.adult-zone.example.org/watch/88.html", 1),
    ("https://m.adult-x.example.net/es/3", 1),
    ("https://hot-adult.example.com/fr/17?page=2", 1),
    ("https://casino-royal.example.com/en/bonus", 1),
    ("http://blog.casino-win.example.org/de/12", 1),
    ("https://best-casino.example.net/slots/", 1),
    ("https://www.online-casino.example.com/fr/9.html", 1),
    ("https://free-bets.example.com/en/4", 1),
    ("http://sport-bets.example.org/es/21/", 1),
    ("https://m.free-bets.example.net/live?ref=x", 1),
    ("https://www.bets-now.example.com/de/6", 1),
    ("https://cheap-pills.example.org/en/order.html", 1),
    ("http://blog.cheap-pills.example.com/fr/2", 1),
    ("https://pills-shop.example.net/buy/", 1),
    ("https://m.diet-pills.example.com/en/30", 1),
    ("https://spam-farm.example.com/en/5/", 1),
    ("http://www.spam-links.example.org/de/8", 1),
    ("https://link-farm.example.net/es/44.html", 1),
    ("https://m.spam-mail.example.com/fr/13", 1),
    ("https://ads-track.example.org/en/pixel", 1),
    ("http://m.ads-click.example.com/es/7", 1),
    ("https://track-ads.example.net/de/19/", 1),
    ("https://www.ads-serve.example.com/en/2.html", 1),
    ("https://library.example.org/en/1/", 0),
    ("http://www.museum.example.com/watch/88.html", 0),
    ("https://m.weather.example.net/es/3", 0),
    ("https://garden.example.com/fr/17?page=2", 0),
    ("https://blog.history.example.com/en/notes", 0),
    ("http://blog.cooking.example.org/de/12", 0),
    ("https://school.example.net/lessons/", 0),
    ("https://www.university.example.com/fr/9.html", 0),
    ("https://thenews.example.com/en/4", 0),
    ("http://thering.example.org/es/21/", 0),
    ("https://m.theory.example.net/live?ref=x", 0),
    ("https://www.thermal.example.com/de/6", 0),
    ("https://tennis.example.org/en/order.html", 0),
    ("http://blog.tidings.example.com/fr/2", 0),
    ("https://painting.example.net/buy/", 0),
    ("https://m.nations.example.com/en/30", 0),
    ("https://m.station.example.com/en/5/", 0),
    ("http://www.other.example.org/de/8", 0),
    ("https://bread.example.net/es/44.html", 0),
    ("https://m.stream.example.com/fr/13", 0),
    ("https://thousand.example.org/en/pixel", 0),
    ("http://m.heritage.example.com/es/7", 0),
    ("https://answers.example.net/de/19/", 0),
    ("https://www.orchard.example.com/en/2.html", 0),
    ("https://blog.edition.example.org/de/5120?utm_source=feed", 0),
    ("https://m.reading.example.com/en/777#top", 0),
)


def host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lowered."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(host_col: Column, path_col: Column) -> Column:
    """All character n-grams of the marked host and path, repeats included, each with its kind before it."""

    def of(kind: str, text: Column, n: int) -> Column:
        last = F.length(text) - n + 1
        # a text shorter than n has none
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(kind), F.substr(text, i, F.lit(n))))

    marked = (("h", F.concat(F.lit("^"), host_col, F.lit("$"))), ("p", F.concat(F.lit("^"), path_col, F.lit("$"))))
    return F.flatten(F.array(*[of(kind, text, n) for kind, text in marked for n in GRAMS]))


def _features(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` (with host and path) and their hashed n-gram counts as ``features``."""
    return HashingTF(numFeatures=1 << bits, inputCol="grams", outputCol="features").transform(rows.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, label int")


def fit(labelled: DataFrame, bits: int = BITS, ridge: float = 0.01) -> LogisticRegressionModel:
    """``labelled``: (url, label), small, with both labels."""
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL")
    rows = rows.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(regParam=ridge, standardization=False, maxIter=50, tol=1e-9).fit(_features(rows, bits))


def fitting_rule(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """Index of the longest rule that fits, else null."""
    found = F.lit(None).cast("int")
    # the shortest first, so that the longest is asked first
    for i, (_, rule_host, rule_path) in sorted(enumerate(rules), key=lambda r: (len(r[1][1]) + len(r[1][2]), -r[0])):
        under = (host_col == rule_host) | host_col.endswith("." + rule_host)
        found = F.when(under & path_col.startswith(rule_path), F.lit(i)).otherwise(found)
    return found


def judge(pages: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, host, path, rule, verdict, probability (the regression's, whatever the rule)."""
    cut = pages.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    cut = cut.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    bits = model.numFeatures.bit_length() - 1
    scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("p").transform(_features(cut, bits)).withColumn("probability", vector_to_array("p")[1])
    names = F.array(*[F.lit(h + p) for _, h, p in rules]).cast("array<string>")
    says = F.array(*[F.lit(v) for v, _, _ in rules]).cast("array<string>")
    learned = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", F.get(names, F.col("fits")).alias("rule"), F.coalesce(F.get(says, F.col("fits")), learned).alias("verdict"), "probability")
