"""Removal of every byte covered by a long string that also starts earlier, over whole texts.

Method: bucket-pointer refinement over sampled suffixes. Of the ``q``-grams in each window of ``length``
bytes the one with the smallest hash is the window's anchor; equal windows have equal anchors at equal
places, so only anchors need buckets. A run is all windows with one anchor. Runs start in the bucket of
their anchor's q-gram. A bucket with one run holds nothing that repeats and is done. A bucket whose runs
have equal bytes is done too: all but the first repeat it. Any other bucket is refined: the first run of
each text is cut by the distance of its windows from the anchor into pieces of at most 16, then 4,
then 1 windows, and a piece's bucket is told by all bytes that its windows share, which reach to later
offsets than the bucket before. What a round finds is what the next one starts from. At the end a
bucket is one string of ``length`` bytes, and its pointer is the earliest place of that string.

Buckets are told apart by two 64-bit hashes, of the shared and of all bytes. They are never gathered:
counts, smallest and largest hash and first place are aggregates that combine before the shuffle, and
members meet them in joins that can be split, whatever share of all rows a bucket has.

Defined results: null is an empty text; texts shorter than ``length`` lose nothing. Places are ordered by
doc_id, nulls last, then by start; rows that repeat an id are places of the same document, so equal
rows do not remove each other's bytes but each lose what also starts earlier. Every input row gives
a row; an empty table gives none; other columns are ignored (or kept, in ``without_repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ruletrace.llm.common import (byte_column, doc_slices, fresh, mixed, prefix_sums, settled, span_hash, table, utf8)

LENGTH, GRAM = 100, 24
PIECES = (16, 4, 1)
SEGMENT = 4 << 20
ROWS = "bucket long, bytes long, doc long, place long"
LOW = np.uint64(0xFFFFFF)


def places(first: np.ndarray, anchor: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First window, anchor and last window of a run in one number that orders by the first window."""
    return (first << 16) | ((anchor - first) << 8) | (last - first)


def placed(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = place >> 16
    return first, first + (place >> 8 & 0xFF), first + (place & 0xFF)


def segments(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first document, document after the last, first byte, byte after the last). A long document comes in
    segments that overlap, so that each window lies in exactly one."""
    for lo, hi in doc_slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo == 1:
            for at in range(a, max(b - length + 1, a + 1), SEGMENT):
                yield lo, hi, at, min(b, at + SEGMENT + length - 1)
        else:
            yield lo, hi, a, b


def runs(raw: np.ndarray, offsets: np.ndarray, length: int, q: int):
    """Anchor hash, hash of all bytes, document, first window, anchor and last window of every run."""
    n, wide = len(raw), length - q + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    sums, at = prefix_sums(raw), np.arange(n - q + 1)
    grams = span_hash(sums, at, at + q)
    least, size = (grams & ~LOW) | at.astype(np.uint64), 1
    while 2 * size <= wide:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if wide > size:
        least = np.minimum(least[:size - wide], least[wide - size:])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = np.flatnonzero(at[:len(least)] + length <= offsets[1:][doc[:len(least)]])
    if not len(good):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    anchor = (least[good] & LOW).astype(np.int64)
    new = np.ones(len(good), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1] + 1)
    start = np.flatnonzero(new)
    first, last = good[start], good[np.append(start[1:], len(good)) - 1]
    return grams[anchor[start]], span_hash(sums, first, last + length), doc[first], first, anchor[start], last


def first_buckets(texts: DataFrame, length: int, q: int) -> DataFrame:
    """A row for every run of every text (columns doc and text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, offsets = byte_column(batch.column(1))
            for lo, hi, a, b in segments(offsets, length):
                inner = np.clip(offsets[lo:hi + 1], a, b) - a
                bucket, every, doc, first, anchor, last = runs(raw[a:b], inner, length, q)
                shift = a - offsets[lo:hi][doc]  # from bytes of the segment to bytes of the document
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(every.view(np.int64)), pa.array(ids[lo:hi][doc]),
                     pa.array(places(first + shift, anchor + shift, last + shift))], ["bucket", "bytes", "doc", "place"])

    return texts.mapInArrow(run, ROWS)


def refined(texts: DataFrame, members: DataFrame, length: int, size: int) -> DataFrame:
    """Pieces of at most ``size`` windows of the runs in ``members`` (doc, place, bytes), in the buckets of what
    their windows share."""
    own = members.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("place", "bytes")).alias("found"))
    joined = texts.join(own, F.col("doc") == F.col("of")).select("doc", "text", "found.place", "found.bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw, offsets = byte_column(batch.column(1))
            listed = batch.column(2)
            at = listed.offsets.to_numpy()
            place = listed.flatten().to_numpy()
            every = batch.column(3).flatten().to_numpy().view(np.uint64)
            for lo, hi in doc_slices(offsets):
                mine = slice(at[lo] - at[0], at[hi] - at[0])
                doc = np.repeat(np.arange(lo, hi), np.diff(at[lo:hi + 1]))
                base = offsets[doc] - offsets[lo]
                first, anchor, last = (x + base for x in placed(place[mine]))
                sums = prefix_sums(raw[offsets[lo]:offsets[hi]])
                # An id may be repeated with another text: a run belongs to the text that has its bytes.
                good = np.flatnonzero(last + length <= offsets[doc + 1] - offsets[lo])
                good = good[span_hash(sums, first[good], last[good] + length) == every[mine][good]]
                first, anchor, last, doc, base = (x[good] for x in (first, anchor, last, doc, base))
                low, high = (anchor - last) // size, (anchor - first) // size
                count = high - low + 1
                row = np.repeat(np.arange(len(count)), count)
                block = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                a = np.maximum(first[row], anchor[row] - block * size - size + 1)
                b = np.minimum(last[row], anchor[row] - block * size)
                shared = span_hash(sums, anchor[row] - block * size, anchor[row] - block * size - size + 1 + length)
                bucket = mixed(shared + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                whole = span_hash(sums, a, b + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[doc[row]]),
                     pa.array(places(a - base[row], anchor[row] - base[row], b - base[row]))],
                    ["bucket", "bytes", "doc", "place"])

    return joined.mapInArrow(run, ROWS)


def round_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that repeat an earlier one (doc, place, bytes), and first runs of buckets that need refinement."""
    buckets = settled(rows.groupBy(F.col("bucket").alias("of")).agg(
        F.count("*").alias("n"), F.min("bytes").alias("low"), F.max("bytes").alias("high"))
        .where("n > 1").select("of", (F.col("low") != F.col("high")).alias("open")), "buckets")
    members = settled(rows.join(buckets, F.col("bucket") == F.col("of")).drop("of"), "members")
    firsts = settled(members.groupBy("bucket", "bytes").agg(
        F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n"), F.first("open").alias("open"))
        .select("bucket", "bytes", F.col("first.doc").alias("first_doc"), F.col("first.place").alias("first_place"),
                "n", "open"), "firsts")
    repeats = settled(members.join(firsts.where("n > 1").drop("open", "n"), ["bucket", "bytes"])
                      .where("doc <> first_doc OR place <> first_place").select("doc", "place", "bytes"), "repeats")
    active = firsts.where("open").select(F.col("first_doc").alias("doc"), F.col("first_place").alias("place"), "bytes")
    return repeats, active


def repeated_runs(docs: DataFrame, length: int = LENGTH, q: int = GRAM) -> DataFrame:
    """doc, place and bytes of all runs and pieces whose windows also start earlier."""
    texts = docs.select(ordered_id().alias("doc"), utf8(F.col("text")).alias("text"))
    found, active = round_of(first_buckets(texts, length, q))
    for size in PIECES:
        more, active = round_of(refined(texts, active, length, size))
        found = found.unionByName(more)
    return found


def ordered_id():
    """The id that places are ordered by; null comes last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def _with_runs(docs: DataFrame, length: int, q: int) -> DataFrame:
    """docs with its bytes and the repeated runs of each document, in columns that clash with none."""
    own, place, every, text = (fresh(docs, f"_{x}") for x in ("doc", "place", "hash", "utf8"))
    found = repeated_runs(docs, length, q).groupBy(F.col("doc").alias(own)).agg(
        F.collect_list("place").alias(place), F.collect_list("bytes").alias(every))
    return docs.withColumn(text, utf8(F.col("text"))).join(found, ordered_id() == F.col(own), "left") \
        .select(*(docs[c] for c in docs.columns), text, place, every)


def removals(batch: pa.RecordBatch, at: int, length: int) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """Text, mask of the bytes that stay, and number of removed spans, for each row. Columns from ``at``: text,
    places, hashes."""
    places_of, bytes_of = batch.column(at + 1), batch.column(at + 2)
    for i, value in enumerate(batch.column(at)):
        text = value.as_py()
        stays = np.ones(len(text), bool)
        if places_of[i].is_valid:
            first, _, last = placed(places_of[i].values.to_numpy())
            every = bytes_of[i].values.to_numpy().view(np.uint64)
            fits = last + length <= len(text)
            first, stop, every = first[fits], last[fits] + length, every[fits]
            mine = span_hash(prefix_sums(np.frombuffer(text, np.uint8)), first, stop) == every
            edges = np.zeros(len(text) + 1, np.int64)
            np.add.at(edges, first[mine], 1)
            np.add.at(edges, stop[mine], -1)
            stays = np.cumsum(edges[:-1]) == 0
        gone = np.concatenate([[False], ~stays])
        yield text, stays, int((gone[1:] & ~gone[:-1]).sum())


def suffix_dedup(docs: DataFrame, length: int = LENGTH, q: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(text), int(len(text) - stays.sum()), spans, hashlib.sha256(
                np.frombuffer(text, np.uint8)[stays].tobytes()).hexdigest())
                for text, stays, spans in removals(batch, 2, length)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                                             names)

    return _with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, q).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, q: int = GRAM) -> DataFrame:
    """``docs`` with what is left of each text, all other columns as they are, n_chars counted anew.

    A character that lost a byte goes as a whole. A null text stays null.
    """
    names, schema = docs.columns, StructType(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.frombuffer(text, np.uint8)[stays].tobytes().decode("utf-8", "ignore")
                    for text, stays, _ in removals(batch, len(names), length)]
            columns = dict(zip(names, batch.columns, strict=False))
            known = columns["text"].is_valid().to_pylist()
            columns["text"] = pa.array([t if k else None for t, k in zip(kept, known, strict=True)], columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) if k else None for t, k in zip(kept, known, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return _with_runs(docs, length, q).mapInArrow(run, schema)


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))
