"""Records of JSON exports as rows of text, cut out of files by byte ranges.

A file is a list of records, ``{"records": [...]}`` with any other keys, or records one after the other. It is read as the
pieces between closing braces, which Spark splits among tasks as it splits lines. A first pass tells for each split how it changes
what a reader must know: whether a string is open, how deep the nesting is, and whether the array around is that of the
records. These few numbers per split are put in file order, and a second pass cuts the records, knowing where it starts. A
record that lies in several splits is put together from its parts. Nothing is parsed here but braces, brackets and quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# A whole string, with the array it may be the key of; a string that is still open at the end; nesting.
TOKEN = re.compile(rb'(?P<whole>"(?:[^"\\]|\\.)*+"(?P<array>\s*:\s*\[)?)|(?P<open>")|(?P<nest>[\[\]{])', re.S)
REST_OF_STRING = re.compile(rb'(?:[^"\\]|\\.)*+(?P<end>"(?P<array>\s*:\s*\[)?)?', re.S)
RECORDS = re.compile(rb'"records"\s*:\s*\[')
LIST, WRAPPED, PLAIN = 1, 2, 0      # how deep records lie


class CutOff(Exception):
    """Malformed records: a file ends inside one."""


@dataclass
class Reader:
    """What is known of the place after the pieces read so far. ``arrays`` tells for each depth whether the last array opened
    there is that of the records."""

    string: bool = False
    depth: int = 0
    least: int = 0
    arrays: dict[int, bool] = field(default_factory=dict)

    def read(self, piece: bytes, closed: bool = True, record: int | None = None) -> int:
        """Take in a piece, with the brace behind it if it is ``closed``. Where a brace opens a record at depth ``record``, or -1."""
        at, opened = 0, -1
        if self.string:
            rest = REST_OF_STRING.match(piece)
            at, self.string = rest.end(), rest["end"] is None
            if rest["array"] is not None:
                self._array(False)
        if not self.string:
            for token in TOKEN.finditer(piece, at):
                if token["open"] is not None:
                    self.string = True
                    break
                if token["array"] is not None:
                    self._array(RECORDS.fullmatch(token["whole"]) is not None)
                elif token["nest"] == b"[":
                    self._array(False)
                elif token["nest"] == b"{":
                    if self.depth == record and opened < 0 and (record != WRAPPED or self.arrays.get(1)):
                        opened = token.start()
                    self.depth += 1
                elif token["nest"] == b"]":
                    self._up()
        if closed and not self.string:
            self._up()
        return opened

    def _array(self, of_records: bool) -> None:
        self.arrays[self.depth] = of_records
        self.depth += 1

    def _up(self) -> None:
        self.depth -= 1
        self.least = min(self.least, self.depth)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, Iterator[bytes]]]:
    """(file and start, size of the file, pieces) of each split of a task."""
    def rows() -> Iterator[tuple[tuple[str, int], int, bytes]]:
        for batch in batches:
            for file, block, size, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield (file, block), size, piece

    from itertools import groupby
    for (split, size), found in groupby(rows(), key=lambda r: r[:2]):
        yield split, size, (piece for *_, piece in found)


EFFECTS = ("file string, block long, size long, bytes long, first string, "
           "effects array<struct<string: boolean, depth: int, least: int, arrays: map<int, boolean>>>")


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does to a reader that starts outside of a string, and to one inside."""
    for (file, block), size, pieces in _splits(batches):
        both, n, first = (Reader(), Reader(string=True)), 0, ""
        for piece in pieces:
            for reader in both:
                reader.read(piece)
            n += len(piece) + 1
            first = first or piece.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("ascii", "replace")
        yield pa.RecordBatch.from_pylist([dict(
            file=file, block=block, size=size, bytes=n, first=first,
            effects=[dict(string=r.string, depth=r.depth, least=r.least, arrays=list(r.arrays.items())) for r in both])],
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("first", pa.string()),
                       ("effects", pa.list_(pa.struct([("string", pa.bool_()), ("depth", pa.int32()), ("least", pa.int32()),
                                                       ("arrays", pa.map_(pa.int32(), pa.bool_()))])))]))


@dataclass(frozen=True)
class Start:
    """Where a split starts: inside a string, how deep, in the records' array, in a record that began in split ``owner``."""

    string: bool
    depth: int
    in_records: bool
    owner: int | None
    record: int         # depth of this file's records
    unclosed: bool      # no brace follows the last piece


def starts(rows: list) -> dict[tuple[str, int], Start]:
    """The start of every split, from the effects of all of them: a few numbers per split."""
    files: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        files.setdefault(r["file"], []).append(r)
    out: dict[tuple[str, int], Start] = {}
    for file, splits in files.items():
        first = next((s["first"] for s in splits if s["first"]), "")
        # Without the last brace a byte is counted that the file does not have; a mark at its start is not counted.
        unclosed = (sum(s["bytes"] for s in splits) - splits[0]["size"]) % 3 == 1
        kinds = [LIST] if first == "[" else [WRAPPED, PLAIN]
        for record in kinds:
            string, depth, in_records, owner, found, wrapped = False, 0, False, None, {}, False
            for s in splits:
                last = s is splits[-1]
                found[file, s["block"]] = Start(string, depth, in_records, owner, record, unclosed and last)
                e = s["effects"][int(string)]
                inside, arrays = owner is not None and depth + e["least"] > record, dict(e["arrays"] or {})
                in_records = arrays.get(1 - depth, in_records)
                wrapped |= arrays.get(1 - depth, False)
                string, depth = e["string"], depth + e["depth"] + (unclosed and last and not e["string"])
                if depth <= record or record == WRAPPED and not in_records:
                    owner = None
                elif not inside:
                    owner = s["block"]
            if record == WRAPPED and not wrapped:
                continue
            if string or depth:
                raise CutOff(f"Malformed records: {file} ends inside of one")
            out |= found
            break
    return out


def _cut(pieces: Iterator[bytes], start: Start) -> Iterator[tuple[int | None, str]]:
    """(owner, text) of the records of a split; an owner is given for the parts of records that other splits hold too."""
    reader = Reader(start.string, start.depth, 0, {1: start.in_records})
    parts: list[bytes] | None = [] if start.owner is not None else None
    owner, piece = start.owner, next(pieces, None)
    while piece is not None:
        following = next(pieces, None)
        closed = following is not None or not start.unclosed
        opened = reader.read(piece, closed, start.record)
        if opened >= 0:
            parts, owner, piece = [], None, piece[opened:]
        if parts is not None:
            parts += [piece, b"}"] if closed else [piece]
            if not reader.string and reader.depth <= start.record:
                yield owner, b"".join(parts).decode()
                parts, owner = None, None
        piece = following
    if parts is not None:
        yield owner if owner is not None else -1, b"".join(parts).decode()


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file or a folder of files as (value), each a JSON object."""
    pieces = (spark.read.option("lineSep", "}").text(path)
              .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("piece")))
    known = spark.sparkContext.broadcast(starts(pieces.mapInArrow(_effects, EFFECTS).collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split, _, rows in _splits(batches):
            held: list[tuple] = []
            for owner, text in _cut(rows, known.value[split]):
                held.append((text, None, None, None, None) if owner is None
                            else (None, split[0], split[1] if owner < 0 else owner, split[1], text))
                if len(held) == 1024:
                    yield batch(held)
                    held = []
            yield batch(held)

    def batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          ["value", "file", "owner", "block", "part"])

    # A part is no record, so it has a column of its own: whoever parses values early meets whole ones only.
    cut = pieces.mapInArrow(run, "value string, file string, owner long, block long, part string")
    # Parts of one record: as many as splits it reaches over.
    whole = (cut.filter("part IS NOT NULL").groupBy("file", "owner")
             .agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
             .select(F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("value")))
    return cut.filter("value IS NOT NULL").select("value").unionByName(whole)
