"""Quality rules per document, and verdicts per host from shrunk failure rates.

Method: every document is measured; rule failures are summed by host; the hosts' rates give a beta
prior by the method of moments; each host's rate is shrunk towards it, and a host whose shrunk rate
is over ``host_limit`` fails as a whole. Host verdicts are joined back to the documents.

Defined results: a null or empty text has no words and fails (fewer than ``min_words``). A null host
is a host of its own. Repeated rows are measured each for itself and all count for their host. An
empty table gives no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ruletrace.llm.common import (BLANK_WORDS, byte_column, chained, doc_slices, mixed, prefix_sums, settled,
                                  span_hash, utf8, word_spans)

SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20
HOST_LIMIT = 0.5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which have an equal key before them."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return many, later


def _measure(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n_docs = len(offsets) - 1
    starts, ends, firsts = word_spans(raw, offsets, BLANK_WORDS)
    n_words = np.diff(firsts)
    sums = prefix_sums(raw)
    chars = _totals(((raw & 0xC0) != 0x80) & BLANK_WORDS[raw], offsets)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    symbols = _totals(is_symbol[raw], offsets)

    doc_of_word = np.repeat(np.arange(n_docs), n_words)
    windows = chained(span_hash(sums, starts, ends), WINDOW)
    repeated = np.zeros(len(starts), bool)
    if len(windows):
        whole = np.flatnonzero(doc_of_word[: len(windows)] == doc_of_word[WINDOW - 1:])
        own = windows[whole] ^ mixed(doc_of_word[whole].astype(np.uint64) + np.uint64(1))
        hits = whole[_again(own)[0]]
        for k in range(WINDOW):
            repeated[hits + k] = True
    repeats = _totals(repeated, firsts)

    breaks = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(raw == 0x0A) + 1]))
    breaks = breaks[breaks < len(raw)]
    stops = np.append(breaks[1:], len(raw))
    stops = stops - ((stops > breaks) & (raw[stops - 1] == 0x0A)) if len(breaks) else stops
    worded = np.searchsorted(starts, stops) > np.searchsorted(starts, breaks)
    breaks, stops = breaks[worded], stops[worded]
    doc_of_line = np.searchsorted(offsets, breaks, "right") - 1
    lines = span_hash(sums, breaks, stops) ^ mixed(doc_of_line.astype(np.uint64) + np.uint64(1))
    dup_lines = np.bincount(doc_of_line[_again(lines)[1]], minlength=n_docs)
    return [n_words, chars, symbols, dup_lines, repeats]


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, and the five measures of every row, each text read once and whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = byte_column(batch.column(2))
            for lo, hi in doc_slices(offsets):
                part = _measure(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], *(pa.array(x.astype(np.int64)) for x in part)],
                    ["doc_id", "host", *MEASURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                       utf8(F.col("text")).alias("text")).mapInArrow(
        run, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def host_verdicts(failures: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: n, failed, shrunk rate, and whether the host as a whole is kept.

    ``failures`` has host and failed (boolean). The prior comes from all hosts: with mean m and
    variance v of their rates, its strength is m (1 - m) / v - 1, at least 1. Where hosts do not
    differ (or there is one) the prior is as strong as the mean host has rows.
    """
    hosts = failures.groupBy("host").agg(F.count("*").alias("n"),
                                         F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n")
    m, v = F.col("mean_rate"), F.col("var_rate")
    prior = hosts.agg(F.avg(rate).alias("mean_rate"), F.var_pop(rate).alias("var_rate"),
                      F.avg("n").alias("mean_n"))
    strength = F.when(v > 0, F.greatest(F.lit(1.0), m * (1 - m) / v - 1)).otherwise(F.col("mean_n"))
    # One row of three numbers meets every host.
    return (hosts.crossJoin(F.broadcast(prior.select(m, strength.alias("strength"))))
            .select("host", "n", "n_failed",
                    ((F.col("n_failed") + m * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate"))
            .withColumn("host_kept", F.col("rate") <= limit))


def quality(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures, base_failed, host_rate and kept for every row of ``docs`` (doc_id, text, host)."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = settled(measured(docs, host).withColumn("base_failed", failed), "quality-rows")
    hosts = settled(host_verdicts(rows.select("host", F.col("base_failed").alias("failed")), limit)
                    .select(F.col("host").alias("of_host"), "rate", "host_kept"), "quality-hosts")
    # Rows of one host may be a third of all: a sort-merge join that adaptive execution can split.
    joined = rows.join(hosts, rows["host"].eqNullSafe(hosts["of_host"]), "left")
    return joined.select("doc_id", "host", *MEASURES, "base_failed", F.col("rate").alias("host_rate"),
                         (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def op9_quality_rules(spark, sf_dir):
    from ruletrace.llm.common import table
    return quality(table(spark, sf_dir, "documents")).drop("host", "host_rate")


ORACLE = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, generate_series(0, 4) AS t(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f GROUP BY source),
p AS (SELECT avg(k / n) AS mu, var_pop(k / n) AS v, avg(n) AS mean_n FROM h),
s AS (SELECT source, (k + mu * st) / (n + st) <= 0.5 AS host_kept
      FROM h, (SELECT mu, CASE WHEN v > 0 THEN greatest(1.0, mu * (1 - mu) / v - 1) ELSE mean_n END AS st FROM p))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_kept AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""
