"""Row files that a rerun writes byte for byte alike."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F

from ruletrace.operators.ordered import numbered
from ruletrace.sources.files import children, move, path_exists, remove, replace_text
from ruletrace.sources.integrity import file_digests

ROWS_PER_FILE = 100_000
DIGESTS = "SHA256SUMS"


def write_ordered(df: DataFrame, order: list[Column], path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """JSON lines in a total order, cut into files of ``rows_per_file`` rows with fixed names, and a list of their digests.

    A row's file follows from its number in the order alone, not from how the rows were dealt. The folder is put in its
    place when it is whole.
    """
    spark, beside = df.sparkSession, f"{path.rstrip('/')}-{uuid4().hex}"
    rows = numbered(df, order, "_place").withColumn("_file", F.floor((F.col("_place") - 1) / rows_per_file))
    (rows.repartition("_file").sortWithinPartitions("_file", "_place").drop("_place")
     .write.partitionBy("_file").json(f"{beside}/rows"))
    for folder in children(spark, f"{beside}/rows"):
        if not folder.startswith("_file="):
            continue
        (part,) = [n for n in children(spark, f"{beside}/rows/{folder}") if n.startswith("part-")]
        move(spark, f"{beside}/rows/{folder}/{part}", f"{beside}/part-{int(folder[6:]):05d}.json")
    remove(spark, f"{beside}/rows")
    if any(n.startswith("part-") for n in children(spark, beside)):
        sums = file_digests(spark, beside).select("digest", F.substring_index("path", "/", -1).alias("name")).orderBy("name").collect()
        replace_text(spark, f"{beside}/_{DIGESTS}", "".join(f"{r['digest']}  {r['name']}\n" for r in sums))
    else:
        replace_text(spark, f"{beside}/part-00000.json", "")
        replace_text(spark, f"{beside}/_{DIGESTS}", "")
    if path_exists(spark, path):
        remove(spark, path)
    move(spark, beside, path)
