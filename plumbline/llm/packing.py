"""Sequence packing (operator 5): first-fit decreasing with a tournament tree, in randomised groups of documents.

Tokenizing is one pass over Arrow batches: each document's ids, closed by the end id, are cut into pieces of the
sequence length and a rest, and only a piece's place, length and checksum go on.  Whole pieces are sequences by
themselves.  Rests are dealt at random (by a hash of the row's number, which is written down first, so a lost task is
redone alike) to groups of about `group_tokens` tokens or, where most are short, of about `group_rows` rests; the
number of groups follows from the tokens and the rows of all rests.
Within a group rests go, longest first, into the first sequence with room, which a tournament tree over the free
room of the sequences finds in logarithmic time.  Both bounds hold whatever the documents are, so a group fits one task.

Cases: a null or blank text is the end id alone; bytes that are not UTF-8 are read as U+FFFD; null ids and rows that
repeat are documents of their own; ties in length go by row number; an empty table gives an empty result; columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, octets


@dataclass(frozen=True)
class PackParams:
    path: str
    end_id: int = 2
    length: int = 4096
    group_tokens: int = 8_000_000
    group_rows: int = 500_000
    cached: int = 1_000_000  # strings between blanks, and pieces of them, whose ids a worker remembers
    seed: int = 11


#: Fixed value: how the vocabulary splits text between blanks (its file's own pattern).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words:
    """Little-endian ids of strings between blanks; the tokenizer drops white space and never looks across it.

    Strings not seen lately are split into the tokenizer's own pieces, and the pieces not seen lately go to it in one
    call, a blank between them: each piece's ids end with one that closes a word.  That is done for plain Latin
    letters, whose lower-casing is beyond doubt; the tokenizer gets any other string by itself, whole.
    """

    def __init__(self, p: PackParams):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(p.path), p.cached
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = regex.compile(SPLIT).findall
        self.closing = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def alone(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        if len(self.pieces) > self.most:
            self.pieces.clear()
        parts = {}
        for w in words:
            if not w.isprintable() or not (w.isascii() or max(w) < "\u0130"):
                self.known[w] = self.alone(w)
            elif w.isalpha():
                parts[w] = (w.lower(),)
            elif w[:-1].isalpha():
                parts[w] = (w[:-1].lower(), w[-1])
            elif "<|" in w:
                self.known[w] = self.alone(w)
            else:
                parts[w] = self.split(w.lower())
        new = list({q for found in parts.values() for q in found if q not in self.pieces})
        if new:
            ids = self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids
            ends = [k + 1 for k, i in enumerate(ids) if i in self.closing]
            if len(ends) == len(new):
                data, start = array("I", ids).tobytes(), 0
                for q, end in zip(new, ends, strict=True):
                    self.pieces[q] = data[4 * start : 4 * end]
                    start = end
            else:
                self.pieces.update((q, self.alone(q)) for q in new)
        piece = self.pieces.__getitem__
        for w, found in parts.items():
            n = len(found)
            self.known[w] = piece(found[0]) if n == 1 else piece(found[0]) + piece(found[1]) if n == 2 else b"".join(map(piece, found))

    def ids(self, words: list[str]) -> bytes:
        known = self.known
        if new := set(words).difference(known):
            self.learn(set(words) if len(known) > self.most else new)
        out = b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > 64:
                known.pop(w, None)
        return out


_loaded: dict[PackParams, Words] = {}


def id_blocks(text: str, p: PackParams) -> Iterator[bytes]:
    """The document's ids, in blocks, with the end id."""
    if p not in _loaded:
        _loaded[p] = Words(p)
    if text.isascii() and "<|" not in text:
        text = text.lower()  # as the tokenizer does; fewer strings to learn
    words = text.replace("\n", " ").split(" ")
    for k in range(0, len(words), 65536):
        yield _loaded[p].ids(words[k : k + 65536])
    yield array("I", [p.end_id]).tobytes()


def pieces_of(text: str, p: PackParams) -> list[tuple[int, int, int]]:
    """(start, length, checksum) of a document's pieces."""
    out, held, start, size = [], b"", 0, 4 * p.length
    for block in id_blocks(text, p):
        held += block
        at = 0
        while len(held) - at >= size:
            out.append((start, p.length, zlib.crc32(memoryview(held)[at : at + size])))
            start, at = start + p.length, at + size
        held = held[at:]
    if held:
        out.append((start, len(held) // 4, zlib.crc32(held)))
    return out


def first_fit_decreasing(lengths: list[int], room: int) -> list[int]:
    """The bin of each length, longest first into the first bin with room.

    The tree's leaves are the bins' free room, its inner nodes the larger of their children; going left wherever the
    left child is roomy enough ends at the first bin that fits.
    """
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    tree = [room] * (2 * size)
    bins = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, at = lengths[k], 1
        while at < size:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[k] = at - size
        tree[at] -= need
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
    return bins


def tokenize(docs: DataFrame, p: PackParams) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            at, cols = [], ([], [], [], [])
            for k, text in enumerate(batch.column("text")):
                found = pieces_of(octets(text).decode(errors="replace"), p)
                tokens = found[-1][0] + found[-1][1]
                at += [k] * len(found)
                for col, values in zip(cols, (*zip(*found, strict=True), [tokens] * len(found)), strict=True):
                    col.extend(values)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int32())), *[pa.array(c, pa.int64()) for c in cols]], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, p: PackParams) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    pieces = cut(tokenize(docs, p).withColumn("row", F.monotonically_increasing_id()))
    rests = pieces.where(F.col("length") < p.length)
    tokens, count = rests.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = 1 + max(tokens // p.group_tokens, count // p.group_rows)

    def fill(rows):
        rows = rows.sort_values("row")
        lengths = rows["length"].tolist()
        bins = first_fit_decreasing(lengths, p.length)
        used: dict[int, int] = {}
        offsets = []
        for b, n in zip(bins, lengths, strict=True):
            offsets.append(used.get(b, 0))
            used[b] = offsets[-1] + n
        return rows.assign(sequence_id=rows["part"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns=["part", "row"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    dealt = rests.withColumn("part", F.pmod(F.xxhash64("row", F.lit(p.seed)), F.lit(groups)))
    whole = pieces.where(F.col("length") == p.length).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("row").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("part").applyInPandas(fill, schema).unionByName(whole)
