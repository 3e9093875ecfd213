"""Token ids as binary files (operator 13): frequent ids get few bytes, numpy reads them back by table lookup.

Documents are put in ascending order of their ids by Spark's range partitioning, tokenized there and written once as
Parquet.  All ids are counted over all documents; an id's rank by frequency takes its place (a table as long as the
vocabulary).  Files of a bounded number of ranks then hold, byte-aligned, one to four bytes for each rank, and apart
from them the control bytes: two bits for each rank say how many bytes it has, four ranks share a control byte.

    magic | documents, ids, data bytes (3 x uint64) | crc32 of what follows (uint64)
    ids of the documents (int64) | null marks (uint8) | ids in each document (uint64) | control bytes | data bytes

Reading looks up the four lengths of each control byte in a table of 256 rows, adds them up to places, gathers the data
bytes and looks the ranks' ids up.  Which files count is said by a manifest that Spark commits: an attempt of a task
writes under a name of its own, and only the rows of the attempt that succeeded reach the manifest, so a lost executor
or a second attempt leaves at most a file that nobody reads.  A file closes at `file_ids` ids; a document is never
divided, so a longer one has a file to itself, which takes less memory than its text.

Tokenizing is the tokenizers library's.  A batch's texts are cut into words and Arrow finds the different ones; these are
looked up among those seen lately, only new ones go to the library, and numpy puts their ids in the words' places.
Files are written and read through Arrow's file systems (local paths,
hdfs://, s3:// and so on); the folder lies beside the checkpoints unless one is named.

Cases: a null or blank text is what the library makes of it (null: the end id alone); null ids come first; rows that
share an id are documents of their own, in an order that the table's own gives; special tokens' strings in a text are
special tokens, as the library has it; an empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bpe import BYTE_LEVEL, SPLIT, byte_symbols
from plumbline.llm.common import cut, ensure_checkpoint_dir

MAGIC = b"RANKIDS1"
SLICE = 1_000_000  # characters of a text that are looked up at once
GROUP = 8_000_000  # characters of texts that are looked up together
LEARNT = 20_000  # new words that go to the library as one text
SIGNS = frozenset(".,;:!?)-\"'")  # of those that are neither letters nor digits, the common ones
#: Fixed value: white space of the library's patterns beside blank and line feed.
RARE = ("\t", "\x0b", "\x0c", "\r", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")


@dataclass(frozen=True)
class TokenParams:
    path: str
    end_id: int = 0
    file_ids: int = 2_000_000
    cached: int = 1_000_000  # words whose ids a worker remembers


def id_type(p: TokenParams) -> str:
    """The smallest unsigned type that holds every id of the vocabulary."""
    return "<u2" if vocabulary_size(p) <= 1 << 16 else "<u4"


def vocabulary_size(p: TokenParams) -> int:
    with open(p.path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([p.end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


def of_bytes(codes) -> np.ndarray:
    """Which of the 256 bytes are among codes."""
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


BETWEEN, SIGN = of_bytes(b" \n"), of_bytes(map(ord, SIGNS))
#: Bytes other than blanks and letters of the Latin blocks, whose kind no version of Unicode disputes (U+00C0 to U+023F).
OTHER = ~of_bytes(b" \n" + bytes(c for c in range(128) if chr(c).isalpha()) + bytes((*range(0x80, 0xC0), *range(0xC3, 0xC9))))


class Tokens:
    """Ids of whole texts by the tokenizers library, with a memory for words."""

    def __init__(self, p: TokenParams):
        import regex
        from tokenizers import Tokenizer

        with open(p.path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or spec["model"]["type"] != "BPE" or before != BYTE_LEVEL | {"trim_offsets": before.get("trim_offsets")}:
            raise ValueError(f"{p.path} is no byte-level BPE")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{p.path} has added tokens that are not plain strings")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are parallel already
        self.tokenizer, self.most, self.kind = Tokenizer.from_file(p.path), p.cached, id_type(p)
        self.width = np.dtype(self.kind).itemsize
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t["content"]: np.array([t["id"]], self.kind).tobytes() for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.model, self.code = self.tokenizer.model, "HI"[self.kind == "<u4"]
        self.characters = {k: c for k, c in enumerate(byte_symbols())}
        self.pieces = regex.compile(SPLIT)
        self.blank, line = (self.characters[ord(c)] for c in " \n")
        self.begins = np.zeros(vocabulary_size(p), bool)  # ids of tokens that begin with a blank or a line feed
        self.begins[[i for s, i in spec["model"]["vocab"].items() if s[0] in (self.blank, line)]] = True
        self.joined = not any(c in s for s in self.special for c in " \n")  # words side by side make no special token
        self.first: dict[str, bytes] = {"": b""}  # pieces
        self.spaced: dict[str, bytes] = {}  # words with the blank or line feed before them
        self.line = self.alone("\n")
        self.end = np.array([p.end_id], self.kind).tobytes()

    def alone(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.kind).tobytes()

    def letters(self, word: str) -> bytes:
        """The ids of Latin letters behind a blank or a line feed: they are one piece, which goes to the library's model at once."""
        piece = word[1:] if word.isascii() else word[1:].encode().decode("latin-1").translate(self.characters)
        ids = array(self.code, [t.id for t in self.model.tokenize(self.blank + piece if word[0] == " " else piece)]).tobytes()
        return ids if word[0] == " " else self.line + ids

    def others(self, words: list[str]) -> Iterator[bytes]:
        """The ids of any words; the library takes many at once, as one text.

        A split always falls before a word's blank or line feed, which its first token begins with, and no other does.
        """
        if not self.joined:
            yield from map(self.alone, words)
            return
        for at in range(0, len(words), LEARNT):
            ids = np.array(self.tokenizer.encode("".join(words[at : at + LEARNT]), add_special_tokens=False).ids, self.kind)
            data, starts = ids.tobytes(), (np.flatnonzero(self.begins[ids]) * self.width).tolist()
            yield from (data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True))

    def known(self, piece: str) -> bytes:
        found = self.first.get(piece)
        if found is None:
            found = self.alone(piece)
            if len(piece) <= 64:
                if len(self.first) > self.most:
                    self.first = {"": b""}
                self.first[piece] = found
        return found

    def ids_of(self, words: list[str], latin: list[bool]) -> list[bytes]:
        """The ids of different words, each with the blank or line feed before it, or a sign; `latin`: it has but Latin letters."""
        found, rest = list(map(self.spaced.get, words)), []
        gaps = [k for k, x in enumerate(found) if x is None]
        for k in gaps:
            if latin[k]:
                found[k] = self.letters(words[k])
            elif words[k] in SIGNS:
                found[k] = self.known(words[k])
            else:
                rest.append(k)
        for k, x in zip(rest, self.others([words[k] for k in rest]), strict=True):
            found[k] = x
        if len(self.spaced) + len(gaps) > self.most:  # what is in use stays
            self.spaced = {w: x for w, x in zip(words, found, strict=True) if len(w) <= 64}
        else:
            self.spaced.update((words[k], found[k]) for k in gaps if len(words[k]) <= 64)
        return found

    def together(self, parts: list[str]) -> list[bytes]:
        """The ids of plain parts, whose different words are looked up once; a part that begins with a blank goes on from another.

        Words go with the blank or line feed before them.  A sign behind Latin letters is a piece of its own.
        """
        import pyarrow as pa

        text = "".join([x if x[0] == " " else "\n" + x for x in parts])
        data = text.encode()
        codes = np.frombuffer(data, np.uint8)
        other = OTHER[codes]
        if "\xd7" in text or "\xf7" in text:  # two signs among the letters
            other[:-1] |= (codes[:-1] == 0xC3) & ((codes[1:] == 0x97) | (codes[1:] == 0xB7))
        starts = np.flatnonzero(BETWEEN[codes])
        ends = np.append(starts[1:], len(codes))
        n = np.add.reduceat(other, starts, dtype=np.int32)
        signed = (n == 1) & SIGN[codes[ends - 1]] & (ends - starts > 2)
        extra = np.cumsum(signed)
        place = np.arange(len(starts)) + extra - signed  # of each word among words and signs
        bounds = np.full(len(starts) + extra[-1] + 1, len(codes), np.int32)
        bounds[place], bounds[place[signed] + 1] = starts, ends[signed] - 1
        words = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        at = words.indices.to_numpy()
        kind = np.zeros(len(words.dictionary), bool)
        kind[at[place]] = n == signed
        found = self.ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist(), kind.tolist())
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        taken = lengths[at]
        upto = np.cumsum(taken)
        shift = np.cumsum(lengths)[at] - upto  # from a place in the result to one among the different words' ids
        ids = np.frombuffer(b"".join(found), self.kind)[np.arange(upto[-1]) + np.repeat(shift, taken)].tobytes()
        firsts = np.searchsorted(starts, np.cumsum([0, *[len(x.encode()) + (x[0] != " ") for x in parts]])[:-1])
        begin = (self.width * (upto - taken)[place[firsts]]).tolist()
        return [ids[a if x[0] == " " else a + len(self.line) : b] for x, a, b in zip(parts, begin, [*begin[1:], len(ids)], strict=True)]

    def plain(self, text: str) -> bool:
        """Words between single blanks and line feeds: a split always falls before a blank, and around a line feed, here."""
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return False
        return not any(c in text for c in RARE)

    def blocks(self, text: str) -> Iterator[bytes]:
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield self.special[part]
            elif not part:
                continue
            elif not self.plain(part):
                found = (m.group() for m in self.pieces.finditer(part))
                while some := list(islice(found, 65_536)):
                    yield b"".join(map(self.known, some))
            else:
                at = 0
                while at < len(part):
                    end = part.find(" ", at + SLICE) if len(part) - at > SLICE else -1
                    end = len(part) if end < 0 else end
                    yield from self.together([part[at:end]])
                    at = end

    def ids(self, text: str) -> bytes:
        """The text's ids and the end id, little-endian."""
        return b"".join((*self.blocks(text), self.end))

    def many(self, texts: list[str]) -> list[bytes]:
        """`ids` of each text; plain ones are worked on together, up to a bounded number of characters."""
        out, group, held = [b""] * len(texts), [], 0

        def done():
            for k, x in zip(group, self.together([texts[k] for k in group]), strict=True):
                out[k] = x + self.end

        for k, text in enumerate(texts):
            if not text or len(text) > SLICE or any(s in text for s in self.special) or not self.plain(text):
                out[k] = self.ids(text)
                continue
            group.append(k)
            held += len(text)
            if held > GROUP:
                done()
                group, held = [], 0
        if group:
            done()
        return out


_loaded: dict[TokenParams, Tokens] = {}

#: Fixed by the format: lengths of the four ranks of each control byte.
LENGTHS = (1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned ranks."""
    n, size = len(ranks), ranks.itemsize
    more = (ranks > 0xFF).astype(np.uint8)
    if size > 2:
        more += ranks > 0xFFFF
        more += ranks > 0xFFFFFF
    four = np.zeros((-(-n // 4), 4), np.uint8)
    four.reshape(-1)[:n] = more
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    taken = np.arange(size, dtype=np.uint8) <= more[:, None]
    return control.tobytes(), ranks.astype(f"<u{size}", copy=False).view(np.uint8).reshape(n, size)[taken].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """n ranks from control and data bytes."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64)
    starts -= lengths
    ranks = data[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > k)
        ranks[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def pack_file(doc_ids: list, sizes: list[int], ranks: np.ndarray) -> bytes:
    """One file of whole documents."""
    control, data = encode_ranks(ranks)
    none = np.array([x is None for x in doc_ids], np.uint8)
    body = b"".join((np.array([x or 0 for x in doc_ids], "<i8").tobytes(), none.tobytes(), np.array(sizes, "<u8").tobytes(), control, data))
    return b"".join((MAGIC, np.array([len(doc_ids), len(ranks), len(data), zlib.crc32(body)], "<u8").tobytes(), body))


def unpack_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids in each document, ranks) of one file."""
    if content[:8] != MAGIC or len(content) < 40:
        raise ValueError("no file of token ids")
    docs, n, size, crc = map(int, np.frombuffer(content, "<u8", 4, 8))
    at, ends = 40, [8 * docs, docs, 8 * docs, -(-n // 4), size]
    if len(content) != at + sum(ends) or zlib.crc32(memoryview(content)[at:]) != crc:
        raise ValueError("a file of token ids is damaged")
    parts = []
    for step, kind in zip(ends, ("<i8", np.uint8, "<u8", np.uint8, np.uint8), strict=True):
        parts.append(np.frombuffer(content, kind, step // np.dtype(kind).itemsize, at))
        at += step
    ids, none, sizes, control, data = parts
    return [None if gone else i for i, gone in zip(ids.tolist(), none.tolist(), strict=True)], sizes, decode_ranks(control, data, n)


def file_system(folder: str):
    """(Arrow file system, path) of a folder."""
    from pyarrow import fs

    if re.match("file:/", folder):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def ordered_ids(docs: DataFrame, p: TokenParams) -> DataFrame:
    """seq, doc_id, ids: the documents' ids in ascending order of doc_id; seq ascends with them, by one within a range."""

    def of(batches):
        import pyarrow as pa

        if p not in _loaded:
            _loaded[p] = Tokens(p)
        t = _loaded[p]
        for batch in batches:
            ids = t.many([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    return ranges.mapInArrow(of, "doc_id long, ids binary").withColumn("seq", F.monotonically_increasing_id())


def id_counts(rows: DataFrame, p: TokenParams) -> DataFrame:
    """id, n over all documents; each task sends at most one row for each id of the vocabulary."""
    kind, size = id_type(p), vocabulary_size(p)

    def of(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")] or [np.zeros(0, kind)]), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["id", "n"])

    return rows.select("ids").mapInArrow(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def by_frequency(counts: DataFrame, p: TokenParams) -> np.ndarray:
    """All ids of the vocabulary, the commonest first (ties by id); the counts are at most a row for each id."""
    total = np.zeros(vocabulary_size(p), np.int64)
    for r in counts.collect():
        total[r.id] = r.n
    return np.lexsort((np.arange(len(total)), -total)).astype("<u4")


def write_files(rows: DataFrame, order: np.ndarray, folder: str, p: TokenParams) -> DataFrame:
    """Write files of the documents (seq, doc_id, ids); gives the manifest: seq of a file's first document, file, ids in it."""
    kind = id_type(p)
    rank = np.empty(len(order), kind)
    rank[order] = np.arange(len(order))

    def of(batches):
        import pyarrow as pa

        fs, path = file_system(folder)
        first = last = held = 0
        doc_ids, chunks = [], []

        def closed():
            name = f"{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(pack_file(doc_ids, list(map(len, chunks)), rank[np.concatenate(chunks)]))
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([name]), pa.array([held], pa.int64())], names=["seq", "file", "n"])

        for batch in batches:
            for seq, d, x in zip(batch.column("seq").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(x.as_buffer(), kind)
                # a task may read several pieces of the table, in any order: a file holds neighbours only
                if doc_ids and (seq != last + 1 or held + len(ids) > p.file_ids):
                    yield closed()
                    doc_ids, chunks, held = [], [], 0
                if not doc_ids:
                    first = seq
                doc_ids.append(d)
                chunks.append(ids.copy())
                last, held = seq, held + len(ids)
        if doc_ids:
            yield closed()

    return rows.select("seq", "doc_id", "ids").mapInArrow(of, "seq long, file string, n long")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`, the ids in all files before each: running sums within ranges, over one row for each range."""
    parts = cut(manifest.repartitionByRange("seq").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.sum("n").alias("total"))
    before = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")
    return parts.withColumn("within", within).join(F.broadcast(before), "part").select("file", "n", (F.col("before") + F.col("within")).alias("start"))


def write_tokens(docs: DataFrame, p: TokenParams, folder: str | None = None) -> str:
    """Write the documents' ids as files; returns the folder (a new one beside the checkpoints if none is named).

    The folder gets the files, `manifest` (Parquet: file, n, start) and `order` (the ids by frequency).  The tokenized
    table between the two passes is removed at the end.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    cleaned = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(cleaned, "false")
    spark.conf.set(cleaned, "true")  # texts that were shuffled into order are read once
    try:
        ordered_ids(docs, p).write.option("compression", "zstd").parquet(f"{folder}/ordered")
    finally:
        spark.conf.set(cleaned, was)
    rows = spark.read.parquet(f"{folder}/ordered")
    order = by_frequency(id_counts(rows, p), p)
    fs, path = file_system(folder)
    with fs.open_output_stream(f"{path}/order") as f:
        f.write(order.tobytes())
    write_files(rows, order, folder, p).write.parquet(f"{folder}/written")
    with_starts(spark.read.parquet(f"{folder}/written")).write.parquet(f"{folder}/manifest")
    for done in ("ordered", "written"):
        fs.delete_dir(f"{path}/{done}")
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) from the files of a folder."""
    at, path = file_system(folder)
    with at.open_input_stream(f"{path}/order") as f:
        order = np.frombuffer(f.read(), "<u4")

    def of(batches):
        import pyarrow as pa

        fs, path = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}/{name}") as f:
                    doc_ids, sizes, ranks = unpack_file(f.read())
                data, ends = memoryview(order[ranks].tobytes()), np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes.astype(np.int64)
                ids = pa.array([bytes(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + start), ids], names=["doc_id", "start", "ids"])

    manifest = spark.read.parquet(f"{folder}/manifest")
    # few bytes, much work: a number given keeps Spark from putting all files into one task
    dealt = manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return dealt.select("file", "start").mapInArrow(of, "doc_id long, start long, ids binary")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens gives."""
    return rows.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
