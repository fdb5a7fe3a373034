"""Shared helpers: tables, cut lineage, and byte arrays of many texts at once.

Texts reach the tasks as UTF-8 bytes in Arrow batches. A batch is worked on in slices of whole
documents, so the arrays made for it stay small whatever the batch holds; one document is the
smallest slice, and the memory for it is a fixed multiple of its length.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ruletrace.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package even if only the driver's sys.path has it.

    A cluster gets the package by --py-files or an installation; the extra path then does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def utf8(text: Column) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit("").cast("binary"))


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_workspaces: list[list[str]] = []


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are removed at the end, but for those said to ``stay``: what is left must be read from these."""
    _workspaces.append([])
    try:
        yield
    finally:
        for path in _workspaces.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settled(df: DataFrame, name: str, stay: bool = False) -> DataFrame:
    """The frame written once as a table in the shared folder and read back.

    What follows reads files that outlive executors, and the shuffle files of the
    work before are given up as soon as the table stands.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    if _workspaces and not stay:
        _workspaces[-1].append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


# ---- texts of an Arrow batch as one byte array ------------------------------------------------


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the len + 1 offsets of its values. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def doc_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``most`` bytes; a longer document is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(lo + 1, hi), n)
        yield lo, hi
        lo = hi


def word_table() -> np.ndarray:
    """True for the bytes of words that only blanks (x20, x09-x0D) separate."""
    out = np.ones(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = False
    return out


def alnum_table() -> np.ndarray:
    """True for 0-9, A-Z, a-z and all bytes from x80."""
    out = np.zeros(256, bool)
    out[0x30:0x3A] = out[0x41:0x5B] = out[0x61:0x7B] = out[0x80:] = True
    return out


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    return out


BLANK_WORDS, ALNUM_WORDS, LOWERED = word_table(), alnum_table(), lower_table()


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents, and how many words come before each document.

    ``inside`` says which bytes belong to words; words never cross documents.
    """
    word, n = inside[raw], len(raw)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = word[:-1]
    after[:-1] = word[1:]
    before[offsets[offsets < n]] = False
    after[offsets[offsets > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# ---- hashes of any range of bytes --------------------------------------------------------------

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


BYTE_VALUES = np.array([_splitmix(b + 1) for b in range(256)], np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any of their bits may be used."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any range."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * powers(BASE, len(raw)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each range: equal bytes give equal values wherever they stand."""
    back = powers(INVERSE, len(sums))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def chained(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n neighbouring 64-bit values."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    out = values[: len(values) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(BASE) + values[k: len(values) - n + 1 + k]
    return mixed(out)
