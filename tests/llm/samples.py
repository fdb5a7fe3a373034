"""Small tables for the operators: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import random
import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", _bytes string, _doc int, _kept string, _place int, label int, word string, key int, bucket int, host int"


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}{'äß'[rng.randrange(2)] if rng.random() < .1 else ''}" for _ in range(n))


def doc_rows():
    rng = random.Random(7)
    passage, line = words(rng, 70), words(rng, 12)
    texts = [words(rng, rng.randrange(3, 120)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[3].upper(), texts[5] + " one more", "x " + texts[5]]
    texts += [words(rng, 20) + "\n" + passage + "\n" + words(rng, 9) for _ in range(6)]
    texts += [words(rng, 8) + " " + line + " " + words(rng, 8) for _ in range(6)]
    texts += [None, "", " \t\n", "one", "one two", "A b C", "é" * 150, "ab " * 200, words(rng, 6000, 3000), passage * 3]
    rows = [(i, t, "en", f"s{min(i % 7, 3)}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "an id that is null", None, None, None), (None, texts[4], "en", "s0", 1),
             (11, "the same id, another text " + passage, "en", "s1", 5)]
    return rows


def docs(spark, rows=None, extra=False):
    rows = doc_rows() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, DOCS).repartition(3)
    return spark.createDataFrame([(*r, "b", 1, "k", 2, 3, "w", 4, 5, 6) for r in rows], EXTRA).repartition(3)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(doc_id, by):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % by
