"""Operators on document texts against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ruletrace.llm import (decontamination, language_model, license_scan, packing, quality_rules, simhash, suffix_dedup,
                           toxicity)
from tests.llm.samples import DOCS, blank_words, crc, doc_rows, docs, lowered


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ---- suffix-array dedup --------------------------------------------------------------------------


def plain_removals(rows, length):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for doc_id, text, *_ in order:
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            at = (doc_id is None, doc_id or 0, p)
            first[raw[p:p + length]] = min(first.get(raw[p:p + length], at), at)
    out = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p:p + length]] < (doc_id is None, doc_id or 0, p):
                gone[p:p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, q", [(100, 24), (40, 8)])
def test_repeats_are_removed_exactly(spark, length, q):
    rows = doc_rows()
    got = suffix_dedup.suffix_dedup(docs(spark, extra=True), length, q)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_removals(rows, length)


def test_few_letters_and_segments(spark, monkeypatch):
    """Periodic texts, and texts of several segments."""
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(60)) * rng.randrange(1, 6), "", "", 0) for i in range(30)]
    rows.append((30, "".join(r[1] for r in rows[:20]), "", "", 0))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    list_ = [r for r in suffix_dedup.segments(np.array([0, 5000]), 100)]
    assert len(list_) == 10 and list_[1][2:] == (500, 1099)
    got = suffix_dedup.suffix_dedup(docs(spark, rows))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_removals(rows, 100)


def test_texts_without_repeats_keep_their_columns(spark):
    frame = docs(spark, extra=True)
    got = suffix_dedup.without_repeats(frame)
    assert got.dtypes == frame.dtypes and got.count() == frame.count()
    plain = {(r[0], r[4]) for r in plain_removals(doc_rows(), 100)}
    for r in got.collect():
        assert (r["text"] is None) == ((r["doc_id"], r["text"]) in {(x[0], None) for x in doc_rows() if x[1] is None})
        if r["text"] is not None and r["text"].isascii():
            assert (r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) in plain


# ---- SimHash ----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = blank_words(lowered(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    group = list(range(len(fps)))
    for i, a in enumerate(fps):
        for k, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 3 and group[i] != group[k]:
                group = [group[k] if g == group[i] else g for g in group]
    return group


def test_simhash_groups(spark):
    rows = doc_rows()
    fps = [plain_fingerprint(r[1]) for r in rows]
    group = plain_components(fps)
    least = defaultdict(list)
    for g, r in zip(group, rows):
        least[g] += [r[0]] if r[0] is not None else []
    want = sorted(((r[0], f"{f:016x}", min(least[g], default=None)) for r, f, g in zip(rows, fps, group)), key=repr)
    assert rows_of(simhash.simhash_groups(docs(spark, extra=True)), "doc_id", "fingerprint", "component_id") == want


def test_links_of_any_three_bits(spark):
    """Chains and clusters of planted fingerprints, errors in one, two and three segments."""
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        now = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            fps.append(now)
            at, n = rng.choice(simhash.SEGMENTS)
            bits = rng.sample(range(64), 3) if rng.random() < .5 else rng.sample(range(at, at + n), rng.randrange(1, 5))
            now ^= sum(1 << b for b in bits)
    group = plain_components(fps)
    least = {g: min(i for i, x in enumerate(group) if x == g) for g in group}
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    got = simhash.grouped(spark.createDataFrame(signed, "doc_id long, fp long"))
    found = {r["fp"]: r["component_id"] for r in got.collect()}
    assert [found[f] for _, f in signed] == [least[g] for g in group]


def test_golay_code_is_perfect():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 500)
    nearest = words ^ simhash.ERRORS[simhash._syndromes(words)]
    assert (simhash._syndromes(nearest) == 0).all() and (np.bitwise_count(words ^ nearest) <= 3).all()


def test_one_of_each_group_stays(spark):
    frame = docs(spark, extra=True)
    kept = simhash.one_of_each(frame)
    groups = simhash.simhash_groups(docs(spark, [r for r in doc_rows() if r[0] is not None])).collect()
    assert kept.dtypes == frame.dtypes
    ids = [r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()]
    assert sorted(ids) == sorted({r["component_id"] for r in groups})
    assert kept.where("doc_id IS NULL").count() == 2


# ---- quality rules ----------------------------------------------------------------------------------


def plain_quality(text):
    text = text or ""
    w = blank_words(text)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if blank_words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


def test_quality_measures(spark):
    rows = doc_rows() + [(900, "a b\na b\n\n a b\na b\r\nc # * | <x>\nc # * | <x>", "", None, 0)]
    got = quality_rules.quality(docs(spark, rows, extra=True))
    want = []
    for r in rows:
        m = plain_quality(r[1])
        want.append((r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert rows_of(got, "doc_id", *quality_rules.MEASURES, "base_failed") == sorted(want, key=repr)
    assert got.where("kept AND base_failed").count() == 0


def test_failing_hosts_fall_as_a_whole(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 10 + [("few", True)] + [(None, False)] * 50
    for h in range(20):
        rows += [(f"h{h}", i < 5 + h % 3) for i in range(100)]
    got = {r["host"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert not got["bad"]["host_kept"] and got[None]["host_kept"] and got["h1"]["host_kept"]
    assert got["few"]["rate"] < 1.0


# ---- licences -----------------------------------------------------------------------------------------


def test_matching_statistics():
    rng = random.Random(5)
    texts = [[rng.randrange(4) for _ in range(30)] for _ in range(4)]
    automaton = license_scan.Automaton(texts)
    parts = {tuple(t[i:j]) for t in texts for i in range(30) for j in range(i + 1, 31)}
    stream, state, n = [rng.randrange(5) for _ in range(300)], 0, 0
    for at, word in enumerate(stream):
        state, n = automaton.step(state, n, word)
        assert n == max(k for k in range(at + 2) if k == 0 or tuple(stream[at + 1 - k:at + 1]) in parts)
        if n:
            ends = {(i, j) for i, t in enumerate(texts) for j in range(n, 31) if t[j - n:j] == stream[at + 1 - n:at + 1]}
            assert set(automaton.ends[state]) == ends


def test_licence_rows(spark):
    full = license_scan.TEMPLATES[9][1]
    rows = [(1, "Released under the MIT License.", "", "", 0), (2, None, "", "", 0), (3, "", "", "", 0),
            (4, "mit LICENSE and Mit-license, apache license", "", "", 0), (5, "a mit b license", "", "", 0),
            (6, "x " * 50 + full.upper().replace(" ", "\n * ") + " y" * 9, "", "", 0),
            (7, "licensed under cc by nc 4.0", "", "", 0), (8, "the software the software and of the", "", "", 0)]
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs(spark, rows, extra=True)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (1, 3, "mit", 1.0)
    assert (got[2]["n_words"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, None, "", 0.0)
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"], got[4]["base_labels"]) == (3, 0, 5, "apache,mit")
    assert (got[5]["n_base"], got[5]["labels"]) == (0, "")
    assert got[6]["labels"] == "gpl" and got[6]["score"] == 1.0 and got[6]["n_base"] == 1
    assert (got[6]["spans"][0]["start"], got[6]["spans"][-1]["label"]) == (50, "gpl")
    assert got[7]["labels"] == "cc-by-nc" and got[7]["base_labels"] == "" and got[8]["labels"] == ""


# ---- benchmark text -----------------------------------------------------------------------------------


def plain_tiles(item, text, least):
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and free_i[i + n] and free_t[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, t, n)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            free_i[best[0] + k] = free_t[best[1] + k] = False


@pytest.mark.parametrize("seed", range(30))
def test_tiles_are_the_longest_first(seed):
    rng = random.Random(seed)
    item = [rng.randrange(3 + seed % 4) for _ in range(rng.randrange(5, 40))]
    text = [rng.randrange(3 + seed % 4) for _ in range(rng.randrange(5, 60))]
    for at in range(0, len(text) - 12, 17):
        k = rng.randrange(max(1, len(item) - 8))
        text[at:at + 8] = item[k:k + 8]
    assert decontamination.tiles(item, text, 3) == plain_tiles(item, text, 3)


def test_reordered_passages_are_found(spark):
    rng = random.Random(2)
    item = [f"q{i}" for i in range(30)]
    moved = " ".join(item[20:] + ["and"] + item[:9] + ["then"] + item[9:20])
    filler = " ".join(f"z{rng.randrange(999)}" for _ in range(3000))
    rows = [(1, filler + " " + moved.upper() + ". " + filler, "", "", 0), (2, filler, "", "", 0), (3, None, "", "", 0),
            (4, " ".join(item[:8]), "", "", 0), (5, " ".join(item), "", "", 0), (None, " ".join(item[:16]), "", "", 0)]
    bench = spark.createDataFrame([(7, " ".join(item), 1), (8, "too short", 2), (9, None, 3), (None, " ".join(item), 4)],
                                  "item_id long, text string, doc_id int")
    got = decontamination.contaminated(docs(spark, rows, extra=True), bench)
    assert rows_of(got, "doc_id", "item_id", "n_shared") == sorted(
        [(d, i, n) for d, n in ((1, 30), (5, 30), (None, 16)) for i in (7, None)], key=repr)
    kept = decontamination.drop_contaminated(docs(spark, rows, extra=True), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4] and "_bytes" in kept.columns


def test_many_blocks_of_items_find_the_same(spark, monkeypatch):
    rows = doc_rows()
    bench = spark.createDataFrame([(r[0], " ".join(blank_words(r[1])[:25])) for r in rows if r[1]], "item_id long, text string")
    one = rows_of(decontamination.contaminated(docs(spark), bench), "doc_id", "item_id", "n_shared")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    assert len(one) > 60 and rows_of(decontamination.contaminated(docs(spark), bench), "doc_id", "item_id", "n_shared") == one


# ---- packing ------------------------------------------------------------------------------------------


def plain_pack(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(b[0], -b[3], b) for b in bins if b[0] >= size and (s < 0 or s not in b[1]) and (c < 0 or c not in b[2])]
        least = min((f[0] for f in fits), default=None)
        if least is None:
            bins.append([capacity, set(), set(), len(bins)])
            b = bins[-1]
        else:
            b = next(f[2] for f in fits if f[0] == least)
        b[0] -= size
        b[1].add(s)
        b[2].add(c)
        out.append((b[3], b[0]))
    return bins, out


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_takes_the_tightest_bin_without_conflict(seed):
    rng = np.random.default_rng(seed)
    n, capacity = 300, 100
    sizes = np.sort(rng.integers(0, capacity, n))[::-1]
    sources, clusters = rng.integers(-1, 90, n), rng.integers(-1, 200, n)
    where = packing.pack(sizes, [sources, clusters], capacity)
    left, held = defaultdict(lambda: capacity), defaultdict(set)
    for size, s, c, b in zip(sizes.tolist(), sources.tolist(), clusters.tolist(), where.tolist()):
        fits = [left[k] for k in list(left) if left[k] >= size and ("s", s) not in held[k] and ("c", c) not in held[k]]
        assert left[b] == (min(fits) if fits else capacity) if b in left or not fits else False
        left[b] -= size
        held[b] |= {("s", s)} - {("s", -1)} | ({("c", c)} - {("c", -1)})
    assert min(left.values()) >= 0


def test_packing_keeps_every_word_and_no_conflict(spark):
    rows = doc_rows()
    got = packing.packing(docs(spark, extra=True), capacity=100, block_rows=40).collect()
    words = Counter()
    bins = defaultdict(list)
    for r in got:
        words[r["doc_id"]] += r["n_tokens"]
        bins[r["bin"]].append(r)
    want = Counter()
    for r in rows:
        want[r[0]] += len(blank_words(r[1]))
    assert +words == +want and {r["doc_id"] for r in got} == {r[0] for r in rows}
    for b in bins.values():
        assert sum(r["n_tokens"] for r in b) <= 100
        sources = [r["source"] for r in b if r["source"] is not None]
        assert len(sources) == len(set(sources))


# ---- language model -----------------------------------------------------------------------------------


@pytest.mark.parametrize("heads, shard", [(1 << 15, 1 << 24), (12, 3000)])
def test_language_model(spark, monkeypatch, heads, shard):
    monkeypatch.setattr(language_model, "HEADS", heads)
    monkeypatch.setattr(language_model, "SHARD_BYTES", shard)
    rows = doc_rows()
    got = sorted(language_model.lm_scores(docs(spark, extra=True)).collect(), key=lambda r: (repr(r["doc_id"]), r["base_score"]))
    tok = [(r[0], [*blank_words(lowered(r[1])), None]) for r in rows]
    train = [t for i, t in tok if crc(i, 10)]
    c = Counter(w for t in train for w in t)
    pair = Counter(p for t in train for p in zip(["", *t[:-1]], t))
    total = sum(c.values()) + 0.1 * (len(c) + 1)
    want = []
    for i, t in tok:
        base = sum(math.log10((c[w] + 0.1) / total) for w in t)
        score = sum(math.log10((pair[v, w] + 2 * (c[w] + 0.1) / total) / ((c[v] if v else len(train)) + 2))
                    for v, w in zip(["", *t[:-1]], t))
        want.append((i, crc(i, 10) == 0, len(t), sum(c[w] > 0 for w in t), sum(c.values()), base, score))
    for g, w in zip(got, sorted(want, key=lambda r: (repr(r[0]), r[5])), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g["base_score"] == pytest.approx(w[5], rel=1e-9) and abs(g["score"] - w[6]) <= w[2] * language_model.STEP / 2 + 1e-9


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.sort(rng.integers(0, 1 << 63, 999).astype(np.uint64)),
                   np.sort(rng.integers(0, 50, 999).astype(np.uint64)), np.array([3, 1 << 63, (1 << 64) - 1], np.uint64)):
        code = language_model.EliasFano.of(values)
        d = code.dump()
        code = language_model.EliasFano.load(d["low"], d["high"], d["n"])
        code.select()
        assert (code.at(np.arange(len(values))) == values).all()
        x = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 63, 50).astype(np.uint64)])
        got = code.successor(x, np.zeros(len(x), np.int64), np.full(len(x), len(values)))
        assert (got == np.searchsorted(values, x)).all()


# ---- toxicity -----------------------------------------------------------------------------------------


def toxic_rows(n=400):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        bad = rng.random() < .3
        w = [f"c{rng.randrange(300)}" for _ in range(rng.randrange(0 if not bad else 3, 60))]
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["Vile", "rotten", "gruesomely", "gruesomest"]))
        rows.append((i, " ".join(w), "en", "s", 0))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_marginals_are_exact():
    """Forward-backward against all tag sequences."""
    rng = np.random.default_rng(0)
    chain = toxicity.Chain(np.zeros(1), 0.0, 0.7, -0.4, 1.0, 0.0)
    sizes = [4, 0, 1, 6, 2]
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    emission = rng.normal(size=firsts[-1])
    p, clean, pairs = chain.marginals(emission, firsts)
    for a, b, none in zip(firsts[:-1], firsts[1:], clean):
        n, weight, toxic, both = b - a, 0.0, np.zeros(b - a), np.zeros(b - a)
        for tags in range(1 << n):
            t = [tags >> k & 1 for k in range(n)]
            w = math.exp(sum(e for e, x in zip(emission[a:b], t) if x) + sum(
                0.7 if not x and not y else -0.4 if x and y else 0.0 for x, y in zip(t, t[1:])))
            weight += w
            toxic += w * np.array(t)
            both[:-1] += [w * x * y for x, y in zip(t, t[1:])] if n > 1 else []
            zero = w if tags == 0 else zero
        assert p[a:b] == pytest.approx(toxic / weight) and pairs[a:b] == pytest.approx(both / weight)
        assert none == pytest.approx(math.log(zero / weight), abs=1e-12)


def test_toxicity_on_rows_not_learned_from(spark):
    rows, marks = toxic_rows()
    rows += [(None, "rotten vile", "en", "s", 0), (1000, None, None, None, 0), (1001, "", "", "", 0), rows[0]]
    labels = spark.createDataFrame([*marks, (None, 1, 1), (1001, 0, None), marks[0]], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, rows, extra=True), labels).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in marks}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    texts = {r[0]: r[1] for r in rows}
    spans = [texts[r["doc_id"]].encode()[s["start"]:s["stop"]].decode() for r in got for s in r["spans"] if r["doc_id"] is not None]
    assert spans and sum(s.lower().startswith(("vile", "rotten", "gruesome")) for s in spans) / len(spans) > 0.9
    kept = toxicity.drop_toxic(docs(spark, rows, extra=True), labels)
    assert kept.count() == sum(r["predicted"] == 0 for r in got)


# ---- every operator on a table without rows -------------------------------------------------------------


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    frames = [suffix_dedup.suffix_dedup(none), suffix_dedup.without_repeats(none), simhash.simhash_groups(none),
              simhash.one_of_each(none), quality_rules.quality(none), license_scan.license_scan(none),
              decontamination.contaminated(none, bench), decontamination.contaminated(docs(spark), bench),
              packing.packing(none), language_model.lm_scores(none), toxicity.toxicity(none, labels)]
    assert [f.count() for f in frames] == [0] * len(frames)
    assert decontamination.drop_contaminated(docs(spark), bench).count() == docs(spark).count()
    assert {r["score"] for r in toxicity.toxicity(docs(spark), labels).collect()} == {0.0}
