"""SimHash fingerprints, and near-duplicate groups found with Golay-code fuzzy hashing.

Method: the 64 bits are cut into three segments of 21, 21 and 22 bits, each filled up to a word of the
(23, 12) Golay code. Decoding a segment and its one-bit neighbours gives one codeword index or six;
two segments at most one bit apart meet where one gives all of its indices and the other the index of
itself. By the pigeonhole principle two fingerprints three bits apart either differ by one bit in every
segment, or agree in one segment and differ by at most one bit in another. The keys are made for these
two cases. Joins on them give candidates, whose distance is then verified.

Copies are brought together first (one row per fingerprint). Links of at most two bits are taken
from fingerprints with a common one-bit neighbour: at most 65 fingerprints meet there, and a star joins
them, so a large group of near copies gives no pairs. Only keys under which different groups meet are
joined. Groups are connected components.

Defined results: null and empty texts have fingerprint zero, which is linked like any other. Fewer
words than ``width`` are one shingle. Repeated rows each get their row. A null doc_id counts for links
but not for the smallest id; a group without any id has a null component_id. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ruletrace.llm.common import fresh, settled, table, utf8
from ruletrace.llm.components import components

WIDTH, SEED, SHINGLES = 3, 42, 1 << 16
TASK_ROWS = 1 << 14
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """A bit is 1 if over half the shingles' XXH64 values have it; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z, and the blanks x20 and x09-x0D
    n = max(len(words) - width + 1, 1 if words else 0)
    if not n:
        return 0
    plain = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[min(width, len(words)) - 1:].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for lo in range(0, n, SHINGLES):
        part = b"".join([digest(plain[a:b], SEED) for a, b in zip(starts[lo:lo + SHINGLES], ends[lo:lo + SHINGLES], strict=True)])
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


# ---- Golay keys ---------------------------------------------------------------------------------


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


def _errors() -> np.ndarray:
    """The error of at most three bits for each of the 2048 remainders; the code is perfect, each has one."""
    bits = 1 << np.arange(23)
    patterns = [0, *bits.tolist()]
    patterns += [int(a | b) for i, a in enumerate(bits) for b in bits[i + 1:]]
    patterns += [int(a | b | c) for i, a in enumerate(bits) for k, b in enumerate(bits[i + 1:], i + 1) for c in bits[k + 1:]]
    patterns = np.array(patterns)
    out = np.zeros(2048, np.int64)
    out[_syndromes(patterns)] = patterns
    return out


ERRORS = _errors()


def decoded(words: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[_syndromes(words)]) >> 11


def indices(segment: np.ndarray, bits: int) -> np.ndarray:
    """Codeword indices of each segment value and of its one-bit neighbours, six columns, -1 where there are fewer."""
    near = np.stack([decoded(segment), *(decoded(segment ^ (1 << b)) for b in range(bits))], 1)
    near.sort(axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    column = np.cumsum(new, 1) - 1
    out = np.full((len(segment), 6), -1, np.int64)
    rows = np.repeat(np.arange(len(segment)), near.shape[1]).reshape(near.shape)
    out[rows[new], column[new]] = near[new]
    return out


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, role) of all keys; two fingerprints meet where one has role 1 and the other role 2.

    All segments one bit apart at most: role 1 has all indices of the first two segments and the own one
    of the third, role 2 the other way round. One segment equal: role 1 has all indices of another
    segment, role 2 the own one.
    """
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [indices(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    own = [decoded(p) for p in parts]
    out: list[tuple[np.ndarray, np.ndarray, int]] = []

    def add(keys: np.ndarray, good: np.ndarray, role: int) -> None:
        out.append((np.nonzero(good)[0], keys[good], role))

    add((near[0][:, :, None] << 24) | (near[1][:, None, :] << 12) | own[2][:, None, None],
        (near[0] >= 0)[:, :, None] & (near[1] >= 0)[:, None, :], 1)
    add((own[0] << 24 | own[1] << 12)[:, None] | near[2], near[2] >= 0, 2)
    for case, (a, b) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), 1):
        equal = (case << 40 | parts[a] << 12)[:, None]
        add(equal | near[b], near[b] >= 0, 1)
        add(equal | own[b][:, None], np.ones((len(fps), 1), bool), 2)
    return (np.concatenate([r for r, _, _ in out]), np.concatenate([k for _, k, _ in out]),
            np.concatenate([np.full(len(r), role, np.int32) for r, _, role in out]))


def keyed(fps: DataFrame) -> DataFrame:
    """key, role, fp and label for every key of every fingerprint (columns fp and label)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, label = (batch.column(i).to_numpy() for i in (0, 1))
            for lo in range(0, len(fp), 2048):
                rows, keys, roles = golay_keys(fp[lo:lo + 2048].view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(roles), pa.array(fp[lo:lo + 2048][rows]), pa.array(label[lo:lo + 2048][rows])],
                    ["key", "role", "fp", "label"])

    return fps.select("fp", "label").mapInArrow(run, "key long, role int, fp long, label long")


# ---- groups ---------------------------------------------------------------------------------------


def near_stars(fps: DataFrame) -> DataFrame:
    """Links (a, b) of at most two bits: all fingerprints next to one word, with the smallest of them."""
    words = fps.select("fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))")
                       .alias("word"))
    # No more than 65 fingerprints are within one bit of a word.
    met = words.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")


def _labelled(fps: DataFrame, roots: DataFrame, label: str) -> DataFrame:
    """fps with the root of ``label`` in its place."""
    return fps.join(roots, F.col(label) == F.col("node"), "left") \
        .withColumn(label, F.coalesce("root", label)).drop("node", "root")


def _spread(fps: DataFrame) -> DataFrame:
    """Few bytes make many keys, so the number of tasks comes from the rows."""
    return fps.repartition(1 + fps.count() // TASK_ROWS, "fp")


def grouped(rows: DataFrame) -> DataFrame:
    """fp and component_id of every fingerprint in ``rows`` (doc_id, fp)."""
    fps = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprints")
    stars = components(near_stars(_spread(fps)))
    labelled = settled(_labelled(fps.withColumn("label", F.col("fp")), stars, "label"), "labels")
    keys = keyed(_spread(labelled))
    open_keys = settled(keys.groupBy(F.col("key").alias("open")).agg(
        F.min("label").alias("a"), F.max("label").alias("b"), F.bit_or("role").alias("roles"))
        .where("a <> b AND roles = 3").select("open"), "open-keys")
    members = settled(keys.join(open_keys.hint("merge"), F.col("key") == F.col("open"), "left_semi"), "members")
    other = members.where("role = 2").select("key", F.col("fp").alias("fp_b"), F.col("label").alias("label_b"))
    links = members.where("role = 1").join(other, "key").where("label <> label_b AND bit_count(fp ^ fp_b) <= 3")
    roots = components(links.select(F.col("label").alias("a"), F.col("label_b").alias("b")).distinct())
    final = settled(_labelled(labelled, roots, "label"), "labels")
    least = final.groupBy(F.col("label").alias("of")).agg(F.min("least_id").alias("component_id"))
    return settled(final.join(least, F.col("label") == F.col("of")).select("fp", "component_id"), "groups")


def simhash_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text)."""
    rows = settled(fingerprints(docs, width), "simhash")
    groups = grouped(rows).withColumnRenamed("fp", "of")
    # Copies may be a third of all rows: both sides are shuffled as they are, so the join can be split.
    return rows.join(groups, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each group, with all its columns.

    Of rows that repeat that id the one with the smallest text stays. Rows without id cannot be named
    in a group, and all stay.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    own, place = fresh(docs, "_kept"), fresh(docs, "_place")
    keep = simhash_groups(named, width).where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    stays = named.join(settled(keep, "kept-ids"), F.col("doc_id") == F.col(own), "left_semi")
    # Ids are keys, so this window has one row for each; it only matters where an id is repeated.
    stays = stays.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))) \
        .where(F.col(place) == 1).drop(place)
    return stays.unionByName(docs.where(F.col("doc_id").isNull()))


def op5_simhash(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))
