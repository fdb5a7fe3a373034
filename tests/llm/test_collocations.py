"""Collocations against counts of lists of words, in whole tables and in odd rows."""

import random
import re
from collections import Counter

import duckdb
import pytest

from ruletrace.llm import collocations
from tests.llm.samples import doc_rows, docs, lowered

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, top=2000):
    counts, sizes = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in (1, 2, 3):
                counts.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    often = {p: n for p, n in counts.items() if n >= 10 and len(p[1]) > 1}
    inside = Counter()
    for (lang, p), n in often.items():
        for part in (p[:2], p[1:]) if len(p) == 3 else ():
            inside[lang, part] = max(inside[lang, part], n)
    out = []
    for (lang, p), a in often.items():
        if 100 * inside[lang, p] < 50 * a or not inside[lang, p]:
            cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], sizes[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    for lang, *rest in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            yield (lang, ranks[lang], *rest)


def same(got, want):
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(want)


def many_rows():
    """Few words, so that phrases repeat, overlap with themselves and tie; one language has most rows."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        w = []
        for _ in range(rng.randrange(40)):
            w += rng.choice([["the", "red", "fox"], ["the", "red"], ["New", "York"], ["ha", "ha", "ha"], ["Ä", "ö"], [f"w{rng.randrange(60)}"]])
            w[-1] += rng.choice([""] * 6 + [".", "!", "\x0b", ",,"])
        rows.append((i, rng.choice([" ", "\t "]).join(w), [None, "und", "de", "en"][min(3, i % 9)], "s", 0))
    return rows


@pytest.mark.parametrize("bucket", [collocations.BUCKET, 50])
def test_repeated_phrases(spark, bucket):
    rows = many_rows() + doc_rows()
    want = list(plain(rows))
    assert len({r[0] for r in want}) == 3 and any(len(r[2].split()) == 3 for r in want)
    same(collocations.collocations(docs(spark, rows, extra=True), bucket=bucket), want)


def test_the_last_place_is_told_by_the_phrase(spark):
    """Very many phrases with equal scores and counts."""
    rows = [(i * 10 + k, f"a{i} b{i}. x{i} y{i} z{i}", "en", "s", 0) for i in range(60) for k in range(10)]
    same(collocations.collocations(docs(spark, rows), top=25), plain(rows, 25))


def test_frequent_words_are_cut_and_runs_are_short(spark, monkeypatch):
    rows = many_rows()
    words = collocations.vocabulary(docs(spark, rows))
    layout = collocations.Layout.of(words, 50)
    assert len(layout.words) and layout.cuts.max() > 2
    monkeypatch.setattr(collocations, "FREQUENT_SHARE", 10)
    assert len(collocations.Layout.of(words, 50).words) <= 10


def test_whole_table_and_sql(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = list(plain([tuple(r[c] for c in ("doc_id", "text", "lang")) for r in frame.collect()]))
    same(collocations.op13_collocations(spark, SF_DIR), want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    assert sorted(con.execute(collocations.ORACLE).fetchall()) == sorted(want)


def test_no_rows(spark):
    assert collocations.collocations(docs(spark, [])).count() == 0
