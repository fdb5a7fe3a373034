"""Toxicity of long texts: clean words do not add up, and one toxic passage is still found."""

import random

import numpy as np

from ruletrace.llm import toxicity
from tests.llm.samples import docs
from tests.llm.test_texts import toxic_rows

BAD = ["Vile", "rotten", "gruesomely", "gruesomest"]


def noisy_rows(n=600):
    """Clean texts have a toxic word in 1500 words, toxic ones one in 12."""
    rng = random.Random(8)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(BAD) if rng.random() < (1 / 12 if bad else 1 / 1500) else f"c{rng.randrange(300)}"
             for _ in range(rng.randrange(60, 200))]
        rows.append((" ".join(w), float(bad)))
    return rows


def scores(chain, texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, _, features, firsts = toxicity.token_features(raw, offsets)
    p, _, _ = chain.marginals(chain.emissions(features), firsts)
    return chain.score(toxicity.evidence(p, firsts), np.diff(firsts))


def test_false_alarms_do_not_grow_with_length():
    rows = noisy_rows()
    chain = toxicity.fit([t.encode() for t, _ in rows[:400]], np.array([y for _, y in rows[:400]]))
    clean, bad = [t for t, y in rows[400:] if not y], [t for t, y in rows[400:] if y]
    assert (scores(chain, clean) < toxicity.THRESHOLD).mean() > 0.95 and (scores(chain, bad) >= toxicity.THRESHOLD).mean() > 0.95
    joined = [" ".join(clean[i:i + 75]) for i in range(0, 75, 5)]
    assert (scores(chain, joined) < toxicity.THRESHOLD).mean() > 0.9
    hit = [" ".join([*clean[i:i + 30], bad[i], *clean[i + 30:i + 60]]) for i in range(15)]
    assert (scores(chain, hit) >= toxicity.THRESHOLD).mean() > 0.8


def test_long_texts_are_learned_from(spark):
    """The bytes of all texts are bounded, not those of one."""
    rows, marks = toxic_rows(60)
    for k in range(8):
        rows.append((2000 + k, "harmless " * 4000 + ("horrid" if k % 2 else "fine"), "en", "s", 0))
        marks.append((2000 + k, 1, k % 2))
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda texts, toxic, spark: seen.append(texts)
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        toxicity.train(docs(spark, rows), labels)
        toxicity.train(docs(spark, rows), labels, most_bytes=50_000)
    finally:
        toxicity.fit = fit
    assert sum(len(t) > 20_000 for t in seen[0]) >= 4
    assert all(1 <= sum(len(t) for t in s) <= 2 * b for s, b in zip(seen, (toxicity.TRAIN_BYTES, 50_000)))


def test_fit_in_tasks_equals_fit_here(spark):
    rows, marks = toxic_rows(120)
    texts, toxic = [r[1].encode() for r in rows], np.array([m[2] for m in marks], float)
    here, there = toxicity.fit(texts, toxic), toxicity.fit(texts, toxic, spark)
    assert (here.weights == there.weights).all()
    assert (here.bias, here.slope, here.length, here.shift) == (there.bias, there.slope, there.length, there.shift)
