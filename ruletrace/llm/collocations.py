"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

Method: a first pass counts words, which gives the vocabulary (words are told by 64-bit hashes from then on; two words of
one hash are found and refused) and each language's number of words. In the second pass every word keeps a stripe, an associative
counter of its next words, summed over about ``FLUSH`` words in a task before anything is shuffled. In the third pass prefixes of
two words do, but only where both pairs of a phrase of three may be candidates: no phrase occurs more often than its parts. Pairs
with enough occurrences are marked in a bitmap of a fixed size, by hash, so a mark may be there by chance and none is missing.
Stripes go to buckets of about ``BUCKET`` word places, by the hash of their prefix; the stripe of a frequent prefix is cut by the hash of the
next word, in as many parts as its frequency needs, so no bucket grows with the table or with a common word. A
task merges the stripes of a bucket elementwise. From what is merged come the phrases with their counts (extensions), the
counts of their prefixes, and per phrase the greatest count of a phrase that holds it (subsumption maxima).

Defined results: a null text counts as empty, a null language as ``und``. Repeated rows count each time. Empty texts have
no words. Ties are told apart as stated: cuts by their place, phrases by count and then their bytes. Rows without doc_id count like
others; other columns are ignored; an empty table gives no rows. A text of any length is read whole, in memory that is a multiple of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ruletrace.llm.common import (BASE, LOWERED, byte_column, doc_slices, mixed, prefix_sums, settled, span_hash, table, utf8, word_spans)

LEAST, TOP = 10, 2000
#: Of a phrase's occurrences, so many in a hundred inside a longer candidate drop it.
INSIDE_PERCENT, SCALE = 50, 1_000_000
#: Words a task counts before it hands them on; word places in a bucket, and in a part of a frequent prefix.
FLUSH, BUCKET = 1 << 19, 1 << 19
UNKNOWN_LANG = "und"
#: Bits of the bitmap of pairs, and how many of them a task makes.
MARKS, MARKS_CHUNK = 1 << 26, 1 << 16
#: Into how many parts the candidates of a language are dealt to be ranked, before what is left of them meets.
RANKED_APART = (256, 16)

#: Stands for no word, at the end of a piece or of a prefix; no word has this hash.
NONE = np.uint64(0)
#: Words that are this share of all or more are the only ones whose stripes are cut, so their table has so many rows at most.
FREQUENT_SHARE = 1 << 18

BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
INSIDE_WORDS = ~BREAKS
INSIDE_WORDS[[0x20, 0x09]] = False


def word_rows(batches: Iterator[pa.RecordBatch], spelled: bool = False, of: int = FLUSH) \
        -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list]]:
    """Runs of about ``of`` words: hash, language number and piece number of each word, the languages' names, and the words' bytes.

    Words of one piece of one text have the same piece number, and pieces never cross texts. The last is a list of
    (bytes, starts, ends) of the slices the words come from, if they are to be ``spelled``.
    """
    held, n, names, base = [], 0, {}, 0
    for batch in batches:
        raw, offsets = byte_column(batch.column(1))
        langs = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
        for lo, hi in doc_slices(offsets):
            part, own = LOWERED[raw[offsets[lo]:offsets[hi]]], offsets[lo:hi + 1] - offsets[lo]
            starts, ends, firsts = word_spans(part, own, INSIDE_WORDS)
            counts = np.diff(firsts)
            # Breaks before a word, and one more for each text.
            piece = np.cumsum(BREAKS[part])[starts] + np.repeat(np.arange(hi - lo), counts) + base
            base = int(piece[-1]) + 2 if len(piece) else base
            keys = np.maximum(span_hash(prefix_sums(part), starts, ends), NONE + np.uint64(1))
            held.append((keys, np.repeat(langs[lo:hi], counts), piece, (part, starts, ends) if spelled else None))
            n += len(starts)
            if n >= of:
                yield *(np.concatenate(x) for x in list(zip(*held, strict=True))[:3]), list(names), [h[3] for h in held]
                held, n, names, base = [], 0, {x: k for k, x in enumerate(names)}, 0
    if n:
        yield *(np.concatenate(x) for x in list(zip(*held, strict=True))[:3]), list(names), [h[3] for h in held]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), utf8(F.col("text")).alias("text"))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in columns whose equal rows are neighbours."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def vocabulary(docs: DataFrame) -> DataFrame:
    """lang, key, word and n of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, langs, _, names, slices in word_rows(batches, spelled=True):
            order = np.lexsort((keys, langs))
            at = _starts(keys[order], langs[order])
            first = order[at]  # lexsort is stable: the first place of each word
            sizes = np.array([len(s[1]) for s in slices])
            of = np.searchsorted(np.cumsum(sizes), first, "right")
            local = first - (np.cumsum(sizes) - sizes)[of]
            words = [slices[k][0][slices[k][1][i]:slices[k][2][i]].tobytes().decode() for k, i in zip(of, local, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(langs[first])), pa.array(keys[first].view(np.int64)), pa.array(words),
                 pa.array(np.diff(np.append(at, len(keys))))], ["lang", "key", "word", "n"])

    counts = _texts(docs).mapInArrow(run, "lang string, key long, word string, n long")
    counts = settled(counts.groupBy("lang", "key").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("n")), "words")
    if not counts.where("word <> other").isEmpty():
        raise ValueError("two words have the same hash")
    return counts.drop("other")


@dataclass
class Layout:
    """How stripes are dealt: the number of buckets, and the parts that stripes of frequent words have."""

    buckets: int
    words: np.ndarray   # hashes of frequent words, sorted
    cuts: np.ndarray

    @classmethod
    def of(cls, words: DataFrame, bucket: int = BUCKET) -> Layout:
        total = words.agg(F.sum("n")).first()[0] or 0
        least = max(bucket, total // FREQUENT_SHARE)
        rows = words.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()
        found = sorted((r["key"] & (1 << 64) - 1, 1 << (int(r["n"]) // bucket).bit_length()) for r in rows)
        return cls(max(64, 1 << (2 * int(total) // bucket).bit_length()), np.array([k for k, _ in found], np.uint64),
                   np.array([c for _, c in found], np.int64))

    def _of_word(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.ones(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[at] == keys, self.cuts[at], 1)

    def parts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """In how many parts the stripe of each prefix lies: a prefix of two words is no more frequent than the rarer one."""
        return np.where(second == NONE, self._of_word(first), np.minimum(self._of_word(first), self._of_word(second)))


def _prefix_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(BASE) + second)


def counted(first: np.ndarray, second: np.ndarray, following: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different rows and how often each occurs. A row may come twice, so that only its sum is exact."""
    order = np.argsort(mixed(_prefix_hash(first, second) * np.uint64(BASE) + following + langs.astype(np.uint64)))
    columns = [c[order] for c in (first, second, following, langs)]
    at = _starts(*columns)
    return *(c[at] for c in columns), np.diff(np.append(at, len(order)))


STRIPES = "lang string, bucket long, w1 long, w2 long, nexts binary, counts binary"


def pair_marks(pairs: DataFrame) -> np.ndarray:
    """The bitmap of pairs (w1, w2): MARKS bits, whatever the number of pairs."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            at = np.unique(_prefix_hash(first, second) % np.uint64(MARKS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // MARKS_CHUNK), pa.array(at % MARKS_CHUNK)], ["chunk", "bit"])

    def chunk(rows: pa.Table) -> pa.Table:
        bits = np.zeros(MARKS_CHUNK, np.uint8)
        bits[rows.column("bit").to_numpy()] = 1
        return pa.table({"chunk": rows.column("chunk")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    rows = (pairs.select("w1", "w2").mapInArrow(places, "chunk long, bit long").distinct()
            .groupBy("chunk").applyInArrow(chunk, "chunk long, bits binary").collect())
    out = np.zeros(MARKS // 8, np.uint8)
    for r in rows:
        at = r["chunk"] * MARKS_CHUNK // 8
        out[at:at + MARKS_CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(marks: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    at = _prefix_hash(first, second) % np.uint64(MARKS)
    return marks[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1 == 1


def stripes(docs: DataFrame, layout: Layout, marks: np.ndarray | None = None) -> DataFrame:
    """Stripes of words, or with ``marks`` those of marked pairs of words, summed over runs of words: a row for each stripe,
    or part of one, of a run.

    ``w1`` and ``w2`` are the hashes of the prefix (the second NONE for a prefix of one word), ``nexts`` and ``counts`` the
    entries. Prefixes of one word also count where a piece ends.
    """
    shared = docs.sparkSession.sparkContext.broadcast((layout, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, marks = shared.value
        for keys, langs, pieces, names, _ in word_rows(batches):
            on = np.append(pieces[1:] == pieces[:-1], False)
            after = np.where(on, np.append(keys[1:], NONE), NONE)
            if marks is None:
                first, second, following, lang = keys, np.zeros(len(keys), np.uint64), after, langs
            else:
                often = on & marked(marks, keys, after)
                two = np.flatnonzero(often & np.append(often[1:], False))
                first, second, following, lang = keys[two], after[two], after[two + 1], langs[two]
            if not len(first):
                continue
            first, second, following, lang, n = counted(first, second, following, lang)
            prefix, parts = _prefix_hash(first, second), layout.parts(first, second)
            part = (mixed(following) % parts.astype(np.uint64))
            bucket = (mixed(prefix + part) % np.uint64(layout.buckets)).astype(np.int64)
            order = np.lexsort((prefix, bucket, lang))
            first, second, following, n, bucket, lang = (c[order] for c in (first, second, following, n, bucket, lang))
            stripe = _starts(lang, bucket, first, second)
            ends = np.append(stripe, len(order)) * 8
            binary = lambda c: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stripe), [None, pa.py_buffer(ends), pa.py_buffer(c)])
            yield from pa.Table.from_arrays(
                [pa.array(names, pa.string()).take(pa.array(lang[stripe])), pa.array(bucket[stripe]), pa.array(first[stripe].view(np.int64)),
                 pa.array(second[stripe].view(np.int64)), binary(following.astype("<u8")).cast(pa.binary()), binary(n.astype("<i8")).cast(pa.binary())],
                ["lang", "bucket", "w1", "w2", "nexts", "counts"]).to_batches(1 << 14)

    return _texts(docs).mapInArrow(run, STRIPES)


PHRASES = "lang string, w1 long, w2 long, w3 long, n long"


def merged(rows: DataFrame, layout: Layout, least: int = LEAST) -> DataFrame:
    """Stripes merged elementwise, as phrases (lang, w1, w2, w3, n) of two and three words with ``least`` occurrences or more.

    Rows with w2 = 0 are counts of prefixes of one word; those of a cut stripe are to be added up.
    """
    shared = rows.sparkSession.sparkContext.broadcast(layout)

    def run(group: pa.Table) -> pa.Table:
        lang = group.column("lang")[0].as_py()
        nexts = group.column("nexts").combine_chunks()
        following, ends = byte_column(nexts)
        n, _ = byte_column(group.column("counts").combine_chunks())
        following, n, sizes = following.view(np.uint64), n.view(np.int64), np.diff(ends) // 8
        first, second = (np.repeat(group.column(c).to_numpy().view(np.uint64), sizes) for c in ("w1", "w2"))
        order = np.lexsort((following, second, first))
        first, second, following, n = (c[order] for c in (first, second, following, n))
        at = _starts(first, second, following)
        n = np.add.reduceat(n, at)
        first, second, following = (c[at] for c in (first, second, following))
        stripe = _starts(first, second)
        total = np.add.reduceat(n, stripe)
        one, two = first[stripe], second[stripe]
        told = (two == NONE) & ((total >= least) | (shared.value.parts(one, two) > 1))
        often = (n >= least) & (following != NONE)
        w1 = np.concatenate([one[told], first[often]])
        w2 = np.concatenate([two[told], np.where(second == NONE, following, second)[often]])
        w3 = np.concatenate([two[told], np.where(second == NONE, NONE, following)[often]])
        return pa.table({"lang": pa.array([lang] * len(w1), pa.string()), "w1": w1.view(np.int64), "w2": w2.view(np.int64),
                         "w3": w3.view(np.int64), "n": np.concatenate([total[told], n[often]])})

    return rows.groupBy("lang", "bucket").applyInArrow(run, PHRASES)


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)) in whole numbers of 38 digits."""
    whole = lambda c, digits=15: f"CAST({c} AS DECIMAL({digits}, 0))"
    return F.expr(f"({whole(SCALE, 7)} * {whole(a)} * {whole(a)}) div ({whole(left, 18)} * {whole(right, 18)})")


def candidates(phrases: DataFrame) -> DataFrame:
    """lang, w1, w2, w3, a, l, r and score of the phrases that no longer candidate holds too often; from rows of ``merged``."""
    ones = settled(phrases.where("w2 = 0").groupBy("lang", "w1").agg(F.sum("n").alias("n")), "ones")
    first = ones.select("lang", "w1", F.col("n").alias("n1"))
    second = ones.select("lang", F.col("w1").alias("w2"), F.col("n").alias("n2"))
    pairs = settled(phrases.where("w2 <> 0 AND w3 = 0").select("lang", "w1", "w2", F.col("n").alias("a"))
                    .join(first, ["lang", "w1"]).join(second, ["lang", "w2"]), "pairs")
    threes = phrases.where("w3 <> 0").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
    head = pairs.select("lang", "w1", "w2", F.col("a").alias("n12"), "n1")
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("n23"), F.col("n2").alias("n3"))
    cut = (threes.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
           .withColumn("s1", _score("a", "n1", "n23")).withColumn("s2", _score("a", "n12", "n3")))
    early = F.col("s1") <= F.col("s2")
    long = cut.select("lang", "w1", "w2", "w3", "a", F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"),
                      F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"))
    held = threes.select("lang", F.explode(F.array(F.struct(F.col("w1").alias("x"), F.col("w2").alias("y")),
                                                   F.struct(F.col("w2").alias("x"), F.col("w3").alias("y")))).alias("of"), "a")
    most = held.groupBy("lang", F.col("of.x").alias("w1"), F.col("of.y").alias("w2")).agg(F.max("a").alias("most"))
    short = (pairs.join(most, ["lang", "w1", "w2"], "left")
             .where(f"most IS NULL OR 100 * most < {INSIDE_PERCENT} * a")
             .select("lang", "w1", "w2", F.lit(0).cast("long").alias("w3"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"),
                     _score("a", "n1", "n2").alias("score")))
    return settled(short.unionByName(long), "candidates")


def _first_rows(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first rows of each language, found in parts before they meet, with ``rank``."""
    for parts in RANKED_APART:
        apart = Window.partitionBy("lang", "_apart").orderBy(*order)
        rows = (rows.withColumn("_apart", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(parts)))
                .withColumn("_place", F.row_number().over(apart)).where(F.col("_place") <= top).drop("_apart", "_place"))
    return (rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top))


def collocations(docs: DataFrame, top: int = TOP, bucket: int = BUCKET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of each language."""
    words = vocabulary(docs)
    layout = Layout.of(words, bucket)
    ones = settled(merged(stripes(docs, layout), layout), "phrases")
    marks = pair_marks(ones.where("w2 <> 0"))
    threes = settled(merged(stripes(docs, layout, marks), layout).where("w3 <> 0"), "phrases")
    found = candidates(ones.unionByName(threes))
    order = [F.desc("score"), F.desc("a")]
    # Rows at the last place that counts tie on score and count; all of these are named, and names tell them apart.
    last = _first_rows(found, order, top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    near = found.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")
    known = words.where(F.col("n") >= LEAST)
    for k in (1, 2, 3):
        name = known.select("lang", F.col("key").alias(f"w{k}"), F.col("word").alias(f"s{k}"))
        near = near.join(name, ["lang", f"w{k}"], "inner" if k < 3 else "left")
    near = near.withColumn("phrase", F.concat_ws(" ", "s1", "s2", "s3"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return (_first_rows(near, [*order, F.asc("phrase")], top).join(sizes, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op13_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


#: The same counts from lists of words.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^ \t]+') AS w
  FROM documents),
ones AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM pieces) GROUP BY lang, p),
places AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM pieces),
twos AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 10),
threes AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM places WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, 1 AS k, t.f AS a, p.f AS l, q.f AS r
  FROM twos t JOIN ones p ON p.lang = t.lang AND p.p = t.x JOIN ones q ON q.lang = t.lang AND q.p = t.y
  WHERE NOT EXISTS (SELECT 1 FROM threes h WHERE h.lang = t.lang AND 100 * h.f >= 50 * t.f AND ((h.x = t.x AND h.y = t.y) OR (h.y = t.x AND h.z = t.y)))
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 1, t.f, p.f, q.f
  FROM threes t JOIN ones p ON p.lang = t.lang AND p.p = t.x JOIN twos q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 2, t.f, p.f, q.f
  FROM threes t JOIN twos p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN ones q ON q.lang = t.lang AND q.p = t.z),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM ones GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
