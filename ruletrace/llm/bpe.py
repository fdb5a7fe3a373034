"""Encoding and decoding with a given byte-pair vocabulary (BPE with word ends, lower case), by batched merge rounds.

Method: texts are split at the vocabulary's special tokens, normalised and cut into words as the vocabulary file says. The
different words of a slice that a task has not met yet stand one after the other in one flat array of symbols.
In a round the rank of each neighbouring pair is looked up by binary search over the sorted pair keys, each word merges all
occurrences of its lowest-ranked pair, the first of overlapping ones first, and only pairs beside a merge are looked up
anew; a word without a ranked pair leaves the array. A merge makes pairs of higher ranks only, which is checked when the
vocabulary is read, so this gives what merging pair by pair gives. Decoding joins the tokens' strings by blanks,
as a vocabulary without a decoder is decoded.

Python's Unicode tables tell letters and lower case; a text with characters that they do not know is normalised and cut
by the tokenizers package, so that its later tables hold.

Defined results: a null text counts as empty, and has no token and an empty decoded text. Special tokens in a text are
tokens. Repeated rows get equal results, each its own row; an empty table gives no rows; other columns are ignored. A text of
any length is encoded whole; the memory for it is a multiple of its length.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ruletrace.llm.common import SLICE_BYTES, byte_column, doc_slices, table

#: What the vocabulary file says, and what this module does; a file that says something else is refused.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_END = "</w>"
#: Words a task remembers, and symbols of words that are merged at once.
REMEMBERED = 1 << 17
NEVER = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@dataclass
class Vocabulary:
    """Ids, strings and merges. ``keys`` are left * n + right of the mergeable pairs, sorted, with ranks and products beside them."""

    tokens: list[bytes]
    keys: np.ndarray
    ranks: np.ndarray
    products: np.ndarray
    inside: np.ndarray      # id of each byte within a word
    last: np.ndarray        # id of each byte at a word's end
    special: dict[str, int]
    words: str              # pattern of a word

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, cut = said["model"], said["pre_tokenizer"]["pretokenizers"]
        sound = (said["normalizer"]["normalizers"] == NORMALISERS and said["decoder"] is None and model["type"] == "BPE"
                 and model["end_of_word_suffix"] == WORD_END and not any(model[k] for k in (
                     "dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
                 and [c["type"] for c in cut] == ["Split", "ByteLevel"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
                 and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
                 and not any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
        if not sound:
            raise ValueError(f"{path} is no vocabulary of lower-case BPE with word ends")
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in said["added_tokens"]}
        n = 1 + max([*ids.values(), *special.values()])
        strings = [""] * n
        for token, i in [*ids.items(), *special.items()]:
            strings[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([ids[x] for x in column], np.int64) for column in (
            [a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        first = np.full(n, -1, np.int64)  # rank of the first merge that makes a token
        first[made[::-1]] = np.arange(len(merges))[::-1]
        rank = np.arange(len(merges))
        if (first[left] >= rank).any() or (first[right] >= rank).any():
            raise ValueError("a merge comes before the merge that makes one of its parts")
        order = np.argsort(left * n + right, kind="stable")
        characters = byte_characters()
        return cls([s.encode() for s in strings], (left * n + right)[order], rank[order], made[order],
                   np.array([ids[c] for c in characters]), np.array([ids[c + WORD_END] for c in characters]), special,
                   cut[0]["pattern"]["Regex"])

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NEVER if it does not merge, and where it stands in ``keys``."""
        key = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), at

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and the len + 1 offsets of the words. No word is empty."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbol = self.inside[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, place = np.full(len(symbol), NEVER), np.zeros(len(symbol), np.int64)
        stale = np.arange(len(symbol))  # symbols whose pair with the next one must be looked up
        while len(symbol):
            stale = stale[stale < len(symbol) - 1]
            stale = stale[word[stale] == word[stale + 1]]
            rank[stale], place[stale] = self.pair_ranks(symbol[stale], symbol[stale + 1])
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            if (least == NEVER).any():
                over = np.repeat(least == NEVER, counts)
                done.append((word[over], symbol[over]))
                symbol, word, rank, place = (x[~over] for x in (symbol, word, rank, place))
                counts, least = counts[least < NEVER], least[least < NEVER]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(least, counts))
            # Of equal pairs that overlap every other one merges, from the left.
            runs = np.flatnonzero(np.append(True, np.diff(at) != 1))
            along = np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))
            at = at[along % 2 == 0]
            symbol[at] = self.products[place[at]]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            rank[at] = NEVER
            before = at[at > 0] - 1
            rank[before] = NEVER
            moved = np.cumsum(~gone) - 1
            symbol, word, rank, place = (x[~gone] for x in (symbol, word, rank, place))
            # The pair of a merged symbol with the one before it and with the one after it.
            now = moved[at]
            stale = np.unique(np.concatenate([now, now[now > 0] - 1]))
            rank[stale] = NEVER
        word = np.concatenate([w for w, _ in done]) if done else word
        symbol = np.concatenate([s for _, s in done]) if done else symbol
        order = np.argsort(word, kind="stable")
        return symbol[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]).astype(np.int64)


    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings with blanks between them, in UTF-8."""
        if not hasattr(self, "_sizes"):
            self._flat = np.frombuffer(b"".join(t + b" " for t in self.tokens), np.uint8)
            self._sizes = np.array([len(t) + 1 for t in self.tokens])
            self._at = np.cumsum(self._sizes) - self._sizes
        sizes = self._sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self._flat[np.arange(sizes.sum()) + np.repeat(self._at[ids] - before, sizes)].tobytes()[:-1]


@functools.cache
def assigned(character: str) -> bool:
    """Whether Python's tables know a character; those of the tokenizers package may be of a later Unicode."""
    return unicodedata.category(character) != "Cn"


def normal(text: str) -> str:
    """NFC in lower case, each character by itself. White space, which separates words only, stays as it is."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pieces(text: str, most: int = SLICE_BYTES) -> Iterator[str]:
    """The text cut at white space into parts of about ``most`` characters; words are never cut."""
    lo = 0
    while len(text) - lo > most:
        gap = re.compile(r"[ \t\n\r]").search(text, lo + most)
        if gap is None:
            break
        yield text[lo:gap.start()]
        lo = gap.end()
    yield text[lo:]


@dataclass
class Encoder:
    """Encodes texts and remembers the words it has met, up to a bound."""

    vocabulary: Vocabulary
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.cut = regex.compile(self.vocabulary.words)
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") \
            if self.vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        """Nothing is known but the special tokens."""
        self.known = {}
        self.ids, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)
        for token, i in self.vocabulary.special.items():
            self.known["\0" + token] = len(self.known)
            self.ids, self.offsets = np.append(self.ids, i), np.append(self.offsets, len(self.ids) + 1)

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token is one, marked by a first character that no letter follows in a word."""
        if self.parts is None or "<" not in text:
            return self._plain_words(text)
        out: list[str] = []
        for k, part in enumerate(self.parts.split(text)):
            out += ["\0" + part] if k % 2 else self._plain_words(part)
        return out

    def _plain_words(self, text: str) -> list[str]:
        if text.isascii() or all(map(assigned, set(text))):
            return self.cut.findall(normal(text))
        from tokenizers import Regex, normalizers, pre_tokenizers

        lower = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        cut = pre_tokenizers.Split(Regex(self.vocabulary.words), "removed", invert=True)
        return [w for w, _ in cut.pre_tokenize_str(lower)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the len + 1 offsets of the texts."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, new, numbers, sizes = self.known, [], [], []
        for text in texts:
            words = self.words(text)
            sizes.append(len(words))
            for w in words:
                n = known.get(w)
                if n is None:
                    n = known[w] = len(known)
                    new.append(w.encode())
                numbers.append(n)
        if new:
            ids, offsets = self.vocabulary.encode_words(new)
            self.offsets = np.concatenate([self.offsets, offsets[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        numbers = np.array(numbers, np.int64)
        counts = np.diff(self.offsets)[numbers]
        ends = np.concatenate([[0], np.cumsum(counts)])
        picked = np.arange(ends[-1]) + np.repeat(self.offsets[numbers] - ends[:-1], counts)
        return self.ids[picked], ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]


def encoded_texts(encoder: Encoder, texts: pa.Array) -> Iterator[tuple[int, int, list[list[np.ndarray]]]]:
    """(lo, hi, the ids of each text in parts) for runs of rows of a string column."""
    _, offsets = byte_column(texts)
    for lo, hi in doc_slices(offsets):
        whole = [t or "" for t in texts[lo:hi].to_pylist()]
        if hi - lo == 1:
            yield lo, hi, [[encoder.encode([part])[0] for part in pieces(whole[0])]]
            continue
        ids, ends = encoder.encode(whole)
        yield lo, hi, [[ids[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _encoder(docs: DataFrame, path: str):
    """What a task makes its encoder from: the vocabulary, whose size is that of its file."""
    return docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids of every row of ``docs`` (doc_id, text), with the vocabulary at ``path`` on the driver."""
    shared = _encoder(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for lo, hi, parts in encoded_texts(encoder, batch.column(1)):
                ids = [np.concatenate(p).astype(np.int32) for p in parts]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))],
                                                 ["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of rows (doc_id, ids)."""
    shared = _encoder(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(1)[k].values
                text = shared.value.decode(ids.to_numpy() if ids is not None else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[k:k + 1], pa.array([text.decode()])], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text decoded from them, without writing either down."""
    shared = _encoder(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for lo, hi, texts in encoded_texts(encoder, batch.column(1)):
                counts, of_ids, of_text = [], [], []
                for parts in texts:
                    ids, text, n = sha256(), sha256(), 0
                    for part in filter(len, parts):
                        ids.update(part.astype("<u4").tobytes())
                        text.update(b" " * (n > 0) + encoder.vocabulary.decode(part))
                        n += len(part)
                    counts.append(n)
                    of_ids.append(ids.hexdigest())
                    of_text.append(text.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                                                  pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bpe(spark, sf_dir, path: str | None = None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return token_digests(table(spark, sf_dir, "documents"), path)
