"""Key and verdict files, and whether frozen files are still what they were."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ruletrace.functions.cells import strip
from ruletrace.sources.files import empty_files, path_exists, qualified

UNCHANGED, CHANGED, MISSING = "unchanged", "changed", "missing"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A hand-kept CSV, all text, without blank rows. ``row_no`` keeps the file order.

    A CSV with quoted line breaks is one task, so the ids grow along the file.
    """
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .csv(path))
    text = F.concat_ws("", *[F.expr(strip(f"`{c}`")) for c in df.columns])
    return (df.withColumn("row_no", F.monotonically_increasing_id())
            .filter(F.length(text) > 0))


BOM = b"\xef\xbb\xbf"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, digest) from (file, size, line) rows that come file by file, in the order of the lines.

    The reader takes line breaks away, and a byte order mark before the first line. Both are told from the size, so two
    digests run along, with and without the mark.
    """
    now, size, seen, plain, marked = None, 0, 0, None, None

    def close():
        missing = size - seen  # the mark and the last line break
        for h, extra in ((plain, 0), (marked, len(BOM))):
            if missing in (extra, extra + 1):
                h.update(b"\n" * (missing - extra))
                return h.hexdigest()
        raise ValueError(f"{now} changed while it was read")

    out: list[tuple[str, str]] = []
    for batch in batches:
        files, sizes, lines = batch.columns
        for k in range(batch.num_rows):
            file, line = files[k].as_py(), lines[k].as_buffer()
            if file != now:
                if now is not None:
                    out.append((now, close()))
                now, size, seen, plain, marked = file, sizes[k].as_py(), -1, sha256(), sha256(BOM)
            for h in (plain, marked):
                if seen >= 0:
                    h.update(b"\n")
                h.update(line)
            seen += 1 + len(line)
    if now is not None:
        out.append((now, close()))
    yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())],
                                     ["file", "digest"])


def file_digests(spark: SparkSession, path: str, below: bool = False) -> DataFrame:
    """sha-256 of each file under a path, as (path, digest); with ``below`` of those in folders below it too.

    A digest needs a file's bytes in order, so each file passes through one task, line by line: no file is held as a
    whole.
    """
    read = spark.read.option("recursiveFileLookup", below)
    listed = read.format("binaryFile").load(path).select("path", "length", F.col("_metadata.file_path").alias("_file"))
    lines = (read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                     F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("id"))
             .repartition("file").sortWithinPartitions("file", "block", "id").select("file", "size", "line"))
    found = lines.mapInArrow(_streamed, "file string, digest string")
    # A file that is only a mark gives no line, and the reader leaves out files without any byte.
    mark = F.when(F.col("length") == len(BOM), F.lit(sha256(BOM).hexdigest()))
    digests = (listed.join(found, F.col("_file") == F.col("file"), "left")
               .select("path", F.coalesce("digest", mark).alias("digest")))
    empty = [(p, sha256().hexdigest()) for p in empty_files(spark, path, below)]
    return digests.unionByName(spark.createDataFrame(empty, "path string, digest string")) if empty else digests


def frozen_state(spark: SparkSession, file: str, recorded: str) -> DataFrame:
    """One row: the digest of a file and whether it equals the one recorded beside it."""
    digest = file_digests(spark, file).select("digest")
    if not path_exists(spark, recorded):
        return digest.withColumn("state", F.lit(MISSING))
    noted = (spark.read.option("wholetext", True).text(recorded)
             .select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)))).scalar()
    return digest.withColumn("state", F.when(F.col("digest") == noted, F.lit(UNCHANGED))
                             .otherwise(F.lit(CHANGED)))


def latest_digests(manifest: DataFrame) -> DataFrame:
    """The last recorded digest per path of "digest  path" lines with a ``row_no``.

    A file that was rightly changed is listed again, so later lines replace earlier ones;
    lines starting with # are remarks.
    """
    entry = (manifest.filter(F.col("value").rlike(r"^[0-9a-f]{64}\s+\S"))
             .select("row_no", F.regexp_extract("value", r"^([0-9a-f]{64})\s+(\S+)", 1).alias("recorded"),
                     F.regexp_extract("value", r"^([0-9a-f]{64})\s+(\S+)", 2).alias("path")))
    return entry.groupBy("path").agg(F.max_by("recorded", "row_no").alias("recorded"))


def manifest_state(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """Each listed file: unchanged, changed, or missing under ``folder``, at its path below it."""
    lines = spark.read.text(manifest).withColumn("row_no", F.monotonically_increasing_id())
    top = qualified(spark, folder).rstrip("/") + "/"
    found = file_digests(spark, folder, below=True).select(F.expr(f"substring(path, {len(top) + 1})").alias("path"), "digest")
    return (latest_digests(lines).join(found, "path", "left")
            .select("path", "recorded", "digest",
                    F.when(F.col("digest").isNull(), F.lit(MISSING))
                    .when(F.col("digest") == F.col("recorded"), F.lit(UNCHANGED))
                    .otherwise(F.lit(CHANGED)).alias("state")))
