"""URL filters: host and path rules first, logistic regression on hashed character n-grams elsewhere.

A rule is a host and a path prefix written together (``example.com/en/``). It fits its host and all
subdomains if the url's path starts with the rule's path; the longest rule wins (then the longer
host). Rules are matched by joining the dotted suffixes of the distinct hosts to the rule table, so
block lists of any length work. What no rule decides goes to the classifier, which is trained on a
small labelled table of urls: at most ``max_labelled`` distinct ones (smallest XXH64 first).

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty path fits no
rule; without labelled urls of both classes the verdict is the one class there is, or allow.
Repeated rows get a row each, null ids stay; columns beside id and url are ignored, whatever
their names; a url of any length is judged whole.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm.common import cut

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for a null url or one without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, rule_host, rule_path, rule_verdict) of ``(rule, verdict)`` pairs such as ``("net/", "block")``."""
    rows = [(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for r, v in rules]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, rule_verdict string")


def longest_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) for the distinct ``urls(host, path)`` that a rule fits."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (urls.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
            .join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("m"), "rule",
                                "rule_verdict")).alias("best"))
            .select("host", "path", "best.rule", "best.rule_verdict"))


def ngrams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of host and path, ends marked, each host n-gram told apart from the path's."""
    def grams(text: Column, mark: str) -> list[Column]:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        return [F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))),
                            lambda i, n=n: F.concat(F.lit(mark), F.substring(padded, i, F.lit(n)))) for n in sizes]
    return F.concat(*grams(host, "h"), *grams(path, "p"))


def _vectors(urls: DataFrame, buckets: int) -> DataFrame:
    counted = urls.withColumn("_grams", ngrams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=buckets, inputCol="_grams", outputCol="_features", binary=True).transform(
        counted).drop("_grams")


def train(labelled: DataFrame, max_labelled: int = 10_000, buckets: int = 1 << 14):
    """Logistic regression on ``labelled(host, path, blocked)`` (blocked 0 or 1), or the one class as a float."""
    order = F.xxhash64("host", "path")
    rows = (labelled.where("blocked is not null").select("host", "path", F.col("blocked").cast("double").alias("blocked"))
            .distinct().orderBy(order, "host", "path", "blocked").limit(max_labelled))
    rows = cut(_vectors(rows, buckets))
    classes = [r[0] for r in rows.select("blocked").distinct().collect()]  # 0 and 1 at most
    if len(classes) < 2:
        return classes[0] if classes else 0.0
    return LogisticRegression(featuresCol="_features", labelCol="blocked", maxIter=60, regParam=1e-3,
                              probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_hat").fit(rows)


def blocked_score(urls: DataFrame, model, buckets: int = 1 << 14) -> DataFrame:
    """``urls(host, path, ...)`` with ``score``: the model's probability that the url is to be blocked."""
    if isinstance(model, float):
        return urls.withColumn("score", F.lit(model))
    return (model.transform(_vectors(urls, buckets))
            .withColumn("score", F.round(vector_to_array("_p")[1], 6)).drop("_p", "_raw", "_hat", "_features"))


def judge(pages: DataFrame, rules: DataFrame, labelled: DataFrame, id_col: str = "page_id",
          url_col: str = "url", max_labelled: int = 10_000) -> DataFrame:
    """(id, host, path, rule, verdict, score): a row for each page.

    ``labelled(url, blocked)`` trains the classifier.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    best = cut(longest_rule(urls, rules))
    host, path = host_and_path(F.col("url"))
    known = labelled.select(host.alias("host"), path.alias("path"), "blocked")
    scored = blocked_score(urls.join(best, ["host", "path"], "left"), train(known, max_labelled))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule",
                         F.coalesce("rule_verdict", method).alias("verdict"), "score")
