"""Toxic spans with a linear-chain conditional random field, and document scores from its marginals.

Method: two tags (clean, toxic) in a chain over the words of a text. A word's features are its hashed
form and prefixes. Token labels come from the labelled documents: a word is tagged toxic in a toxic
document where its form or a prefix of it stands out among toxic documents; words of clean documents are
clean. Weights and transitions are fitted by penalised maximum likelihood (forward-backward gradients)
on a bounded sample of labelled rows. Forward-backward marginals then tag every text: its evidence is that of
the ``WINDOW`` neighbouring words with most of it, so that clean words do not add up, and words with a
marginal of at least ``span_limit`` are merged into offending spans (byte offsets). The document score is
logistic in the evidence and the logarithm of the length (a longer text has more windows to be the strongest
by chance). It is calibrated on the same sample, each half by a chain of the other half, and on texts
joined from it: clean ones are a longer clean text, and with a toxic one among them a toxic text.

Defined results: null and empty texts have no words, no span and the calibrated score of no evidence.
Without labelled rows of both classes every score is 0. Repeated rows get equal scores, each its own
row; an empty table gives no rows; other columns are ignored. ``labels`` rows with a null doc_id or a
null mark are not learned from; a document with several marks counts as toxic if one of them is 1.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ruletrace.llm.common import (ALNUM_WORDS, LOWERED, byte_column, crc_mod, doc_slices, prefix_sums, span_hash, table, utf8, word_spans)

#: Rows learned from: at most so many toxic and so many clean ones, smallest hashes of the id first, among
#: those whose texts have so many bytes in all, for each class. Texts of any length are read whole; one that does
#: not fit in what is left is passed over.
TRAIN_ROWS, TRAIN_BYTES = 1200, 8 << 20
#: Words over which evidence adds up, and how many texts are joined for the calibration of long ones.
WINDOW, JOINED = 256, (4, 16, 64, 256)
PREFIXES = (3, 4, 5, 6, 8)
BUCKETS = 1 << 18
#: Texts of so many bytes advance together through the chain; more would need fewer steps but more memory.
CHAIN_BYTES = 2 << 20
THRESHOLD, SPAN_LIMIT, STANDS_OUT = 0.3, 0.5, 0.75


def token_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and feature numbers (words x features; -1: none) of all words, and words before each text.

    Features: the whole word, and its first 3, 4, 5, 6 and 8 bytes where it is longer than that.
    """
    raw = LOWERED[raw]
    starts, ends, firsts = word_spans(raw, offsets, ALNUM_WORDS)
    sums = prefix_sums(raw)
    columns = [(span_hash(sums, starts, ends) % np.uint64(BUCKETS)).astype(np.int32)]
    for n in PREFIXES:
        stops = np.minimum(starts + n, ends)
        hashed = span_hash(sums, starts, stops) ^ np.uint64(0x5851F42D4C957F2D * n & 0xFFFFFFFFFFFFFFFF)
        columns.append(np.where(starts + n < ends, (hashed % np.uint64(BUCKETS)).astype(np.int32), -1))
    return starts, ends, np.stack(columns, 1) if len(starts) else np.zeros((0, len(columns)), np.int32), firsts


@dataclass
class Chain:
    """Weights of the field: emission of 'toxic' by feature, bias, transitions, and the calibration."""

    weights: np.ndarray
    bias: float
    stay_clean: float
    stay_toxic: float
    slope: float
    shift: float
    length: float = 0.0

    def emissions(self, features: np.ndarray) -> np.ndarray:
        weights, out = np.append(self.weights, 0.0), np.full(len(features), self.bias)
        for column in features.T:
            out += weights[column]
        return out

    def toxic(self, emission: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """P(toxic) per word, and nothing else."""
        return self.marginals(emission, firsts, whole=False)[0]

    def marginals(self, emission: np.ndarray, firsts: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(toxic) per word, log P(no word toxic) per text, and P(toxic, toxic) of each word and the next.

        All texts advance together, word by word, longest first, so a step is one array operation. Without
        ``whole`` only the first is worked out, with a third of the memory, and the others are empty.
        """
        n_docs, n = len(firsts) - 1, len(emission)
        sizes = np.diff(firsts)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes[order[0]]) if n_docs else 0
        active = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), "right")
        at = firsts[:-1][order]
        # Log odds of (toxic : clean) suffice forward and backward; log Z adds up on the way.
        forward, backward = np.zeros(n), np.zeros(n)
        log_z = np.zeros(n_docs)
        a, b = self.stay_clean, self.stay_toxic  # clean>clean, toxic>toxic; the others weigh 0
        ratio = np.zeros(n_docs)
        for t in range(longest):
            k = active[t]
            i = at[:k] + t
            if t:
                x = ratio[:k]
                to_clean, to_toxic = np.logaddexp(a, x), np.logaddexp(0.0, x + b)
                if whole:
                    log_z[:k] += to_clean
                ratio[:k] = to_toxic - to_clean + emission[i]
            else:
                ratio[:k] = emission[i]
            forward[i] = ratio[:k]
        log_z += np.where(sizes[order] > 0, np.logaddexp(0.0, ratio), 0.0)
        back = np.zeros(n_docs)
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            i = at[:k] + t
            y = back[:k] + emission[i + 1]
            back[:k] = np.logaddexp(0.0, y + b) - np.logaddexp(a, y)
            backward[i] = back[:k]
        p = _chance(np.add(forward, backward, out=forward))
        if not whole:
            return p, log_z, log_z
        all_clean = np.empty(n_docs)
        all_clean[order] = a * np.maximum(sizes[order] - 1, 0) - log_z
        pairs = np.zeros(n)
        if n > 1:
            y = emission[1:] + backward[1:]
            clean = np.logaddexp(a, y)
            toxic = np.logaddexp(0.0, b + y)
            pairs[:-1] = p[:-1] * np.exp(b + y - toxic)
            self._clean_pairs = np.append((1 - p[:-1]) * np.exp(a - clean), 0.0)
        else:
            self._clean_pairs = np.zeros(n)
        last = firsts[1:][sizes > 0] - 1
        pairs[last] = 0
        self._clean_pairs[last] = 0
        return p, all_clean, pairs

    def score(self, found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Chance of a toxic document from the evidence of its strongest window and its number of words."""
        return _chance(self.slope * found + self.length * np.log1p(sizes) + self.shift)


def _chance(odds: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-odds)), made in place."""
    np.negative(np.clip(odds, -500, 500, out=odds), out=odds)
    np.exp(odds, out=odds)
    odds += 1
    return np.reciprocal(odds, out=odds)


def evidence(p: np.ndarray, firsts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Most evidence that ``window`` neighbouring words of each text have: the sum of -log(1 - p)."""
    sums = np.concatenate([[0.0], np.cumsum(-np.log1p(-np.minimum(p, 1 - 1e-12)))])
    out = np.zeros(len(firsts) - 1)
    for i, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
        w = min(window, b - a)
        out[i] = (sums[a + w:b + 1] - sums[a:b + 1 - w]).max()
    return out


def _standing_out(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Lower bound, by feature, of the log odds of toxic documents among those that have it."""
    n, k = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for column in features.T:  # each kind of feature has buckets of its own but for collisions
        seen = np.unique(column[column >= 0] * np.int64(len(toxic)) + doc[column >= 0])
        n += np.bincount(seen // len(toxic), minlength=BUCKETS)
        k += np.bincount(seen // len(toxic), weights=toxic[seen % len(toxic)], minlength=BUCKETS)
    share = toxic.mean()
    # Two standard errors less, so that rare features do not stand out by chance.
    odds = np.log((k + share) / (n - k + 1 - share)) - np.log(share / (1 - share))
    return odds - 2 * np.sqrt(1 / (k + share) + 1 / (n - k + 1 - share))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fit_one(which: int, texts: list[bytes], toxic: np.ndarray, rounds: int = 60, penalty: float = 0.02) -> tuple[Chain | None, dict[int, np.ndarray]]:
    """Chain 0 is fitted on all texts. Chains 1 and 2 are fitted on half of them and give P(toxic) of the words of the other half.

    A chain finds more in texts it was fitted on than in others, so the calibration reads those of the other half.
    """
    if which == 0:
        return _fitted(texts, toxic, rounds, penalty), {}
    half = np.random.default_rng(0).permutation(len(texts)) % 2 + 1
    chain = _fitted([t for t, h in zip(texts, half, strict=True) if h != which], toxic[half != which], rounds, penalty)
    if chain is None:
        return None, {}
    own, marginals = np.flatnonzero(half == which), {}
    for lo, hi in doc_slices(_joined([texts[i] for i in own])[1], CHAIN_BYTES):
        _, _, features, firsts = token_features(*_joined([texts[i] for i in own[lo:hi]]))
        p = chain.toxic(chain.emissions(features), firsts)
        marginals |= {int(i): p[x:y].copy() for i, x, y in zip(own[lo:hi], firsts[:-1], firsts[1:], strict=True)}
    return chain, marginals


def fit(texts: list[bytes], toxic: np.ndarray, spark: SparkSession | None = None) -> Chain | None:
    """The chain fitted and calibrated on labelled texts; None unless both classes are there.

    With ``spark`` each of the three chains is fitted by a task of its own; what a task reads is the sample, whose size is
    bounded by parameters.
    """
    if not len(texts) or toxic.min() == toxic.max():
        return None
    if spark is None:
        parts = [fit_one(which, texts, toxic) for which in range(3)]
    else:
        shared = spark.sparkContext.broadcast((texts, toxic))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for which in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([which]), pa.array([pickle.dumps(fit_one(which, *shared.value))])],
                                                     ["which", "fitted"])

        rows = spark.range(0, 3, 1, 3).mapInArrow(run, "which long, fitted binary").collect()
        parts = [pickle.loads(bytes(r["fitted"])) for r in sorted(rows, key=lambda r: r["which"])]
        shared.destroy()
    chain, marginals = parts[0][0], parts[1][1] | parts[2][1]
    if len(marginals) < len(texts):  # a half with texts of one class only fits no chain
        for lo, hi in doc_slices(_joined(texts)[1], CHAIN_BYTES):
            _, _, features, firsts = token_features(*_joined(texts[lo:hi]))
            p = chain.toxic(chain.emissions(features), firsts)
            marginals = {lo + k: p[x:y].copy() for k, (x, y) in enumerate(zip(firsts[:-1], firsts[1:], strict=True))} | marginals
    _calibrate(chain, [marginals[i] for i in range(len(texts))], toxic)
    return chain


def _calibrate(chain: Chain, marginals: list[np.ndarray], toxic: np.ndarray) -> None:
    rng = np.random.default_rng(1)
    clean, bad = np.flatnonzero(toxic == 0), np.flatnonzero(toxic == 1)
    parts, label, weight = [[i] for i in range(len(toxic))], list(toxic), [1.0] * len(toxic)
    for k in JOINED:
        order = rng.permutation(clean)
        for lo in range(0, len(order) - k + 1, k):
            joined = order[lo:lo + k].tolist()
            # Weights keep the share of toxic texts at any length.
            parts += [joined, [*joined[:k // 2], int(rng.choice(bad)), *joined[k // 2 + 1:]]]
            label += [0.0, 1.0]
            weight += [1.0, len(bad) / len(clean)]
    found, sizes = np.zeros(len(parts)), np.zeros(len(parts))
    for i, of in enumerate(parts):
        p = np.concatenate([marginals[j] for j in of])
        found[i], sizes[i] = evidence(p, np.array([0, len(p)]))[0], len(p)
    label, weight = np.array(label), np.array(weight)
    x = np.stack([found, np.log1p(sizes), np.ones(len(parts))], 1)
    for free in ([0, 1, 2], [0, 2]):  # length never speaks for toxic
        keep, ridge, start = x[:, free], np.array([0.1, 0.1, 1e-3])[free], np.array([1.0, 0.0, 0.0])[free]

        def loss(at: np.ndarray, keep=keep, ridge=ridge, start=start) -> float:
            z = keep @ at
            return float((weight * (np.logaddexp(0.0, z) - label * z)).sum() + (ridge * (at - start) ** 2).sum() / 2)

        at = start
        for _ in range(100):  # logistic calibration by Newton steps, lightly penalised, halved until they gain
            q = 1 / (1 + np.exp(-np.clip(keep @ at, -500, 500)))
            g = keep.T @ (weight * (label - q)) - ridge * (at - start)
            h = keep.T @ (keep * (weight * q * (1 - q))[:, None]) + np.diag(ridge)
            step = np.linalg.solve(h, g)
            while np.abs(step).max() > 1e-9 and loss(at + step) > loss(at):
                step = step / 2
            at = at + step
            if np.abs(step).max() <= 1e-9:
                break
        if len(free) == 2 or at[1] <= 0:
            break
    chain.slope, chain.shift = float(max(at[0], 0.0)), float(at[-1])
    chain.length = float(at[1]) if len(free) == 3 else 0.0


def _fitted(texts: list[bytes], toxic: np.ndarray, rounds: int, penalty: float) -> Chain | None:
    if not len(texts) or toxic.min() == toxic.max():
        return None
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    _, _, features, firsts = token_features(raw, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
    standing, odds = np.append(_standing_out(features, doc, toxic), -np.inf), np.full(len(features), -np.inf)
    for column in features.T:
        np.maximum(odds, standing[column], out=odds)
    tags = (odds >= STANDS_OUT) & (toxic[doc] == 1)
    del odds

    chain = Chain(np.zeros(BUCKETS), -3.0, 1.0, 0.0, 1.0, 0.0)
    used = np.flatnonzero(np.bincount(features.ravel() + 1, minlength=BUCKETS + 1)[1:])
    next_same = np.append(doc[1:] == doc[:-1], False)
    both = np.append(tags[1:] & tags[:-1], False) & next_same
    neither = np.append(~tags[1:] & ~tags[:-1], False) & next_same
    n = max(1, len(doc))
    # Gradient ascent with step sizes by root mean square of past gradients.
    past, rest_past = np.full(len(used), 1e-8), np.full(3, 1e-8)
    for _ in range(rounds):
        p, _, pairs = chain.marginals(chain.emissions(features), firsts)
        off = tags - p
        slope = -penalty * chain.weights
        for column in features.T:  # number -1, no feature, comes first and goes
            slope += np.bincount(column + 1, weights=off, minlength=BUCKETS + 1)[1:]
        slope = slope[used]
        past = 0.9 * past + 0.1 * slope ** 2
        chain.weights[used] += 0.3 * slope / np.sqrt(past)
        rest = np.array([off.sum(), neither.sum() - chain._clean_pairs.sum(), both.sum() - pairs.sum()]) / n
        rest_past = 0.9 * rest_past + 0.1 * rest ** 2
        step = 0.1 * rest / np.sqrt(rest_past)
        chain.bias += step[0]
        chain.stay_clean += step[1]
        chain.stay_toxic += step[2]
    del chain._clean_pairs  # one number a word, which scoring does not need
    return chain


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Chain | None:
    """Fit on a bounded sample of the labelled rows that may be learned from (crc32 of the id mod 4 is not 2)."""
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .where(crc_mod(F.col("doc_id"), 4) != 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    # Of texts that repeat an id the longest one tells the size, so that what is collected is within the bound.
    known = texts.groupBy("doc_id").agg(F.max(F.octet_length("text").cast("long")).alias("size")).join(marks, "doc_id")
    order, picked = [F.xxhash64("doc_id"), F.col("doc_id")], []
    for toxic in (1, 0):
        left = most_bytes
        for r in known.where(F.col("toxic") == toxic).where(F.col("size") <= most_bytes).orderBy(*order).limit(most).collect():
            if r["size"] <= left:
                left -= r["size"]
                picked.append((r["doc_id"], r["toxic"]))
    picked = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    # At most 2 x most ids: a side of a proven size, and so is what comes to the driver.
    rows = (texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect())
    texts = [bytes(r["text"]) for r in rows]
    return fit(texts, np.array([r["toxic"] for r in rows], float), docs.sparkSession)


def _spans(starts: np.ndarray, ends: np.ndarray, p: np.ndarray, limit: float) -> list[tuple[int, int, float]]:
    out: list[tuple[int, int, float]] = []
    hits = np.flatnonzero(p >= limit)
    for run in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1) if len(hits) else []:
        out.append((int(starts[run[0]]), int(ends[run[-1]]), float(p[run].max())))
    return out


def score_texts(chain: Chain | None, texts: pa.Array, limit: float | None = SPAN_LIMIT):
    """(lo, hi, scores, spans per row) for runs of rows of a column of bytes or strings; without ``limit`` no spans."""
    raw, offsets = byte_column(texts)
    for lo, hi in doc_slices(offsets, CHAIN_BYTES):
        if chain is None:
            yield lo, hi, np.zeros(hi - lo), [[] for _ in range(lo, hi)]
            continue
        found = []
        for a, b in doc_slices(offsets[lo:hi + 1]):
            part = offsets[lo + a:lo + b + 1]
            starts, ends, features, firsts = token_features(raw[part[0]:part[-1]], part - part[0])
            where = (starts + part[0], ends + part[0]) if limit is not None else ()
            found.append((chain.emissions(features), np.diff(firsts), *where))
        emission, sizes, *where = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        p = chain.toxic(emission, firsts)
        spans = None
        if limit is not None:
            starts, ends = where
            spans = [_spans(starts[a:b] - o, ends[a:b] - o, p[a:b], limit) if (p[a:b] >= limit).any() else []
                     for a, b, o in zip(firsts[:-1], firsts[1:], offsets[lo:hi], strict=True)]
        yield lo, hi, chain.score(evidence(p, firsts), sizes), spans


SPANS = "array<struct<start: long, stop: long, p: double>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))


def toxicity(docs: DataFrame, labels: DataFrame, chain: Chain | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and offending spans of every row of ``docs`` (doc_id, text)."""
    chain = chain or train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # of fixed size: BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, scores, spans in score_texts(shared.value, batch.column(2)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(scores),
                     pa.array((scores >= THRESHOLD).astype(np.int32)),
                     pa.array([[dict(start=a, stop=b, p=p) for a, b, p in s] for s in spans], SPAN_TYPE)],
                    ["doc_id", "held_out", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
                       utf8(F.col("text")).alias("text")).mapInArrow(
        run, f"doc_id long, held_out boolean, score double, predicted int, spans {SPANS}")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    Only texts go to Python and only scores come back; the rows themselves wait in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        runs = [scores for _, _, scores, _ in score_texts(shared.value, texts, None)]
        return pa.array(np.concatenate([np.zeros(0), *runs]))

    return docs.where(score(F.col("text")) < THRESHOLD)


def op10_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("spans")
