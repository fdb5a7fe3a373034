"""Licence matches, chains and scores against all alignments, and odd rows."""

import random

from ruletrace.llm import decontamination, license_scan
from tests.llm.samples import docs


def plain_matches(template, words, least):
    """(place, place in template, words) of every match that is whole on both sides, in the order they end."""
    out = []
    for i in range(len(words)):
        for k in range(len(template)):
            if words[i] == template[k] and not (i and k and words[i - 1] == template[k - 1]):
                n = 1
                while i + n < len(words) and k + n < len(template) and words[i + n] == template[k + n]:
                    n += 1
                if n >= least:
                    out.append((i, k, n))
    return out


def plain_cover(template, words, least):
    """Most words of a template that matches cover one after the other, no further apart than the template is long."""
    found, size = sorted(plain_matches(template, words, least), key=lambda m: m[0] + m[2]), len(template)
    best = [0] * len(found)
    for j, (i, k, n) in enumerate(found):
        before = [best[x] for x, (a, b, m) in enumerate(found[:j]) if a + m <= i <= a + m + size and b + m <= k]
        best[j] = n + max(before, default=0)
    return max(best, default=0) / size


def test_chains_against_all_alignments():
    rng = random.Random(8)
    for turn in range(120):
        vocabulary = [f"w{i}" for i in range(3 + turn % 5)]
        templates = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 12))] for _ in range(4)]
        templates.append(templates[0][:4])  # one that begins another
        templates.append([*templates[1][2:], "w0"])  # one that holds the end of another
        scanner = license_scan.Scanner([(f"l{i}", " ".join(t)) for i, t in enumerate(templates)], 2, 0.8)
        words = []
        while len(words) < 40:
            t = rng.choice(templates)
            a = rng.randrange(len(t))
            words += rng.choice([t[a:a + rng.randrange(1, 9)], ["none"], [rng.choice(vocabulary)]])
        *_, labels, score, spans = scanner.scan(" ".join(words).encode())
        covers = [plain_cover(t, words, 2) for t in templates]
        assert score == max(covers)
        assert labels == ",".join(sorted(f"l{i}" for i, c in enumerate(covers) if c >= 0.8))
        for label, start, stop, cover in spans:
            assert cover == covers[int(label[1:])] and plain_cover(templates[int(label[1:])], words[start:stop], 2) >= cover


def test_a_short_template_that_begins_a_longer_one():
    notice = "Licensed under the Apache License, Version 2.0"
    for after in ("", " the next sentence", " the license you may not", " other"):
        *_, labels, score, spans = license_scan.Scanner().scan((notice + after).encode())
        assert labels == "apache" and score == 1.0 and ("apache", 0, 8, 1.0) in spans
    own = license_scan.Scanner([("short", "alpha beta gamma delta"), ("long", "alpha beta gamma delta epsilon zeta eta theta")], phrases=[])
    for text in ("alpha beta gamma delta", "alpha beta gamma delta epsilon other"):
        assert own.scan(text.encode())[5] == "short"


def test_odd_rows(spark):
    body = license_scan.TEMPLATES[12][1]
    long = "word " * 150_000
    rows = [(1, long + body + " " + long, "", "", 0), (2, "Released under the MIT license.", "", "", 0), (2, "Released under the MIT license.", "", "", 0),
            (None, "mit license", "", "", 0), (None, None, None, None, None)]
    got = license_scan.license_scan(docs(spark, rows, extra=True)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_base"], r["labels"], r["score"]))
    assert by[1] == [(300_000 + len(body.split()), 0, "mit", 1.0)]
    assert by[2] == [(5, 1, "mit", 1.0)] * 2
    assert sorted(by[None]) == [(0, 0, "", 0.0), (2, 1, "mit", 0.0)]


def test_short_benchmark_items_and_repeated_documents(spark):
    """An item of fewer words than a tile is found where it stands as a whole."""
    rows = [(1, "It was too short, they said", "", "", 0), (2, "too long and short", "", "", 0), (3, "short too", "", "", 0),
            (4, "blue", "", "", 0), (1, "It was too short, they said", "", "", 0), (5, "one two three four five six", "", "", 0)]
    bench = spark.createDataFrame([(7, "Too short"), (8, "Blue"), (9, "one two three four"), (10, "..."), (11, "one two three four six seven")],
                                  "item_id long, text string")
    got = decontamination.contaminated(docs(spark, rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_shared"]) for r in got) == [(1, 7, 2), (1, 7, 2), (4, 8, 1), (5, 9, 4)]
    assert all(r["coverage"] == 1.0 for r in got)
    assert sorted(r["doc_id"] for r in decontamination.drop_contaminated(docs(spark, rows), bench).collect()) == [2, 3]
