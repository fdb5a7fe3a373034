"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Method: host and path are cut into characters; their n-grams are hashed into a vector of fixed size
for each part, and a logistic regression fitted on a small labelled URL table gives the chance that a
url is to be blocked. Everything is DataFrame and SQL functions and Spark's own feature
transformers, which run in the JVM.

Defined results: a null url or one without ``://`` has an empty host and path; no rule fits an empty
host, so the model judges it. Without labelled urls everything unruled is allowed; with labels of one
class everything unruled gets that class. Repeated rows are judged alike, each with a row of its own.
An empty table gives no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ruletrace.llm.common import lower_ascii, table

# Verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
SIZES, BUCKETS = (3, 4), 1 << 12
#: At most so many labelled urls are fitted on, those with the smallest hashes.
TRAIN_ROWS = 4000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host (A-Z only) and path. Both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none does.

    A rule list is an expression; it is meant for some hundreds of rules.
    """
    fits = [(F.lit(h + p), F.lit(v), ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)))
            for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    if not fits:
        return F.lit(None).cast("string"), F.lit(None).cast("string")

    def first(i: int) -> Column:
        return reduce(lambda c, f: c.when(f[2], f[i]), fits[1:], F.when(fits[0][2], fits[0][i]))

    return first(0), first(1)


def parted(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "ruled": verdict})


def features() -> list:
    """Stages from the columns host and path to one vector of hashed n-grams."""
    stages = []
    for part in ("host", "path"):
        for n in SIZES:
            stages += [NGram(n=n, inputCol=f"{part}_chars", outputCol=f"{part}_{n}"),
                       HashingTF(numFeatures=BUCKETS, inputCol=f"{part}_{n}", outputCol=f"{part}_{n}_hashed")]
    return [*stages, VectorAssembler(inputCols=[f"{p}_{n}_hashed" for p in ("host", "path") for n in SIZES],
                                     outputCol="features")]


def with_chars(rows: DataFrame) -> DataFrame:
    """Characters of host and path between marks, so that n-grams know where a part begins and ends."""
    chars = {f"{p}_chars": F.split(F.concat(F.lit("^"), F.lower(F.col(p)), F.lit("$")), "") for p in ("host", "path")}
    return rows.withColumns(chars)


def fitted(labelled: DataFrame, most: int = TRAIN_ROWS):
    """A model from host, path and label (1.0: block), or the only class there is (0.0 without rows)."""
    few = (labelled.dropDuplicates(["host", "path", "label"])
           .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(most))
    classes = [r["label"] for r in few.select("label").distinct().collect()]  # two at most
    if len(classes) < 2:
        return classes[0] if classes else 0.0
    regression = LogisticRegression(maxIter=50, regParam=0.01, standardization=False)
    return Pipeline(stages=[*features(), regression]).fit(with_chars(few))


def url_filter(pages: DataFrame, labelled: DataFrame | None = None,
               rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score for every row of ``pages`` (page_id, url).

    ``labelled`` is a small table of url and label (1: block). Without one, the urls that rules judge
    are the labelled ones.
    """
    rows = parted(pages, rules)
    if labelled is None:
        known = rows.where(F.col("ruled").isNotNull()).select(
            "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    else:
        host, path = url_parts(F.col("url"))
        known = labelled.where(F.col("label").isNotNull()).select(
            host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
    model = fitted(known)
    if isinstance(model, float):
        scored = rows.withColumn("block_score", F.lit(model))
    else:
        scored = model.transform(with_chars(rows)).withColumn(
            "block_score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op3_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))
