"""Batched merge rounds against the tokenizers package."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ruletrace.llm import bpe
from tests.llm.samples import doc_rows, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.read(PATH))


def same(encoder, library, texts):
    ids, ends = encoder.encode(texts)
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        got = ids[ends[k]:ends[k + 1]]
        assert got.tolist() == want.ids, texts[k][:80]
        assert encoder.vocabulary.decode(got).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_odd_texts(encoder, library):
    rng = random.Random(3)
    same(encoder, library, [
        "", " \n", "it's 'tis DON'T we'll I'd 'S", "<|endoftext|>x <|ENDOFTEXT|> \0<|startoftext|><|startoftext|>", "\0<|", "a" * 50, "aaa aaaa",
        "ΟΔΟΣ Σ ΑΣ", "İstanbul é e\u0301 \u212b", "12345 ½ ² 中文字 😀😀", "x" * 3000, "\u1c89\ua7cb a\u0558b \U00010d50", "a\u00a0b\u3000c\x1cd\x85e"])
    same(encoder, library, ["".join(rng.choice("abcdefg hij'st<|>AB é\u0301 中文😀09.,\n") for _ in range(rng.randrange(300))) for _ in range(500)])
    same(encoder, library, ["".join(rng.choice("etaoinshrdlu") for _ in range(3000)) for _ in range(3)])


def test_every_character(encoder, library):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("{}", "a{}B"):
        for lo in range(0, 0x30000, 4096):
            same(encoder, library, [form.format(c) for c in characters[lo:lo + 4096:1 if lo < 0x3000 else 7]])


def test_forgetting_and_pieces(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    for text in ("one two three four five six seven", "eight nine ten eleven one", "<|endoftext|> one"):
        same(encoder, library, [text, text])
    text = " ".join(str(i) for i in range(5000)) + "\n" + "long" * 2000 + " end"
    parts = list(bpe.pieces(text, 500))
    assert len(parts) > 10 and [i for p in parts for i in encoder.encode([p])[0]] == library.encode(text, add_special_tokens=False).ids


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_rows(spark, library):
    rows = [*doc_rows(), (900, "word Ünï " * 200_000, "en", "s", 1)]
    frame = docs(spark, rows, extra=True)
    got = [tuple(r) for r in bpe.token_digests(frame, PATH).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], *digests(library, r[1])) for r in rows), key=repr)
    ids = bpe.encode(frame, PATH)
    assert sorted(((r["doc_id"], len(r["ids"])) for r in ids.collect()), key=repr) == sorted(((g[0], g[1]) for g in got), key=repr)
    texts = bpe.decode(ids, PATH).collect()
    assert sorted(((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in texts), key=repr) == \
        sorted(((g[0], g[3]) for g in got), key=repr)
    none = docs(spark, [])
    assert bpe.token_digests(none, PATH).count() == 0 and bpe.decode(bpe.encode(none, PATH), PATH).count() == 0


def test_whole_table(spark, library):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert sorted(tuple(r) for r in bpe.op11_bpe(spark, SF_DIR).collect()) == \
        sorted((r["doc_id"], *digests(library, r["text"])) for r in frame.collect())


def test_other_vocabularies_are_refused(tmp_path):
    said = json.load(open(PATH, encoding="utf-8"))
    said["decoder"] = {"type": "BPEDecoder", "suffix": "</w>"}
    (tmp_path / "v.json").write_text(json.dumps(said))
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(str(tmp_path / "v.json"))
    said["decoder"] = None
    said["model"]["merges"] = said["model"]["merges"][::-1]
    (tmp_path / "w.json").write_text(json.dumps(said))
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(str(tmp_path / "w.json"))
