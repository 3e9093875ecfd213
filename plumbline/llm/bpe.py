"""BPE encoding and decoding (operator 3): a streaming transducer with bounded lookahead.

Whether a merge is applied at a place depends on text to its right in three ways: its left symbol must have been formed
there, its right symbol must have been formed behind it, and that right symbol must not have been taken first by an
earlier merge that begins with it.  Each of the three is again such a decision, about a merge of higher priority, and it
begins at the same place or one symbol further right.  So a merge looks at most chain * longest token to the right, where

    chain(m) = 1 + max(chain of the merge that forms m's left symbol, of the one that forms its right symbol,
                       of each earlier merge that begins with m's right symbol)

by induction over the priorities: what m waits for reaches at most (chain(m) - 1) * longest from a place that lies at
most one symbol, so at most one longest token, behind m's own.  What lies to the left is settled already.  The largest chain times
the longest token is the merge list's sufficient lookahead.  That holds where each symbol is formed by one merge, before
any merge that takes it, as trained lists have it; for any other list pieces are merged whole.

A stretch of text that the splitting pattern leaves whole is merged in a buffer of that lookahead plus one block; tokens that
end a full lookahead before the buffer's end can no longer change, are emitted, and leave the buffer, so memory beside
the text itself does not grow with the stretch.  Decoding turns ids to bytes block by block and bytes to text by an incremental UTF-8
state machine.

Texts go through Spark as Arrow batches; each row stands alone, so no shuffle takes place.
Cases: a null text is empty: no tokens, digests of nothing.  Special tokens' strings in a text are special tokens, as
the tokenizers library has it.  Null ids and rows that repeat are rows like any other; an empty table gives an empty
result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

from pyspark.sql import DataFrame

#: White space as the tokenizers library's patterns know it, and its byte-level splitting pattern.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

PART = 1_000_000  # characters of a text whose pieces are listed at once

#: The vocabulary files' settings that this transducer follows, and those that must be unset.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")


@dataclass(frozen=True)
class BpeParams:
    path: str
    block: int = 4096  # symbols merged beyond the lookahead
    pieces: int = 65536  # pieces of a text held at once
    cached: int = 400_000  # short pieces whose tokens a worker remembers


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(moved.get(b, b)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], longest: int) -> int | None:
    """Symbols right of a token that can decide it: the longest chain of decisions that wait for one another, times the longest token.

    merges: left, right and formed symbol, highest priority first.  None if a symbol is formed twice, or only after a
    merge that takes it: then no such bound is known.
    """
    formed: dict[int, int] = {}  # chain of the merge that forms a symbol
    begins: dict[int, int] = {}  # longest chain of the merges so far that begin with a symbol
    taken: set[int] = set()
    most = 1
    for left, right, result in merges:
        if result in formed or result in taken:
            return None
        chained = 1 + max(formed.get(left, 0), formed.get(right, 0), begins.get(right, 0))
        begins[left] = max(begins.get(left, 0), chained)
        formed[result] = chained
        taken |= {left, right}
        most = max(most, chained)
    return most * longest


class Transducer:
    def __init__(self, p: BpeParams):
        import regex

        with open(p.path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or model["type"] != "BPE" or before != BYTE_LEVEL | {"trim_offsets": before.get("trim_offsets")} or any(model.get(k) for k in PLAIN):
            raise ValueError(f"{p.path} is no plain byte-level BPE")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{p.path} has added tokens that are not plain strings")
        vocab = model["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.params, self.pattern = p, regex.compile(SPLIT)
        self.byte_id = [vocab[s] for s in symbols]
        self.rank = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.result = [vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.names = [str(i) for i in range(len(self.bytes))]
        longest = max(map(len, self.bytes))
        self.lookahead = sufficient_lookahead([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], longest)
        self.block = max(p.block, longest)  # so that a full buffer always has a token to emit
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cut = regex.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")
        self.known = _Known(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to one buffer: always the pair of highest priority, leftmost first."""
        if len(ids) > 100:
            return self._merge_long(ids)
        rank, result, last = self.rank.get, self.result, len(self.result)
        ranks = [rank(q, last) for q in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == last:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [result[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), last)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), last)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(rank[q], k, *q) for k, q in enumerate(zip(ids, ids[1:])) if q in rank]
        heapq.heapify(heap)
        while heap:
            best, k, a, b = heapq.heappop(heap)
            r = after[k]
            if not alive[k] or ids[k] != a or r < 0 or ids[r] != b:
                continue
            ids[k], alive[r], after[k] = self.result[best], False, after[r]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (q := (ids[x], ids[y])) in rank:
                    heapq.heappush(heap, (rank[q], x, *q))
        return [x for x, live in zip(ids, alive) if live]

    def stream(self, data: Iterator[int]) -> Iterator[int]:
        """Tokens of one piece, given byte by byte; memory is the lookahead and a block (the piece, if no lookahead is known)."""
        if self.lookahead is None:
            yield from self.merge([self.byte_id[b] for b in data])
            return
        held: list[int] = []
        size = self.lookahead + self.block
        while True:
            held += [self.byte_id[b] for b in islice(data, size - len(held))]
            out = self.merge(list(held))
            if len(held) < size:
                yield from out
                return
            done = 0
            for t in out:
                if done + len(self.bytes[t]) > size - self.lookahead:
                    break
                done += len(self.bytes[t])
                yield t
            held = held[done:]

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special tokens, and these (True); long stretches are cut where a split always falls."""
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                yield part, True
                continue
            at = 0
            while len(part) - at > PART:
                found = self.cut.search(part, at + PART // 2)
                if not found:
                    break
                yield part[at : found.start()], False
                at = found.start()
            if at < len(part):
                yield part[at:] if at else part, False

    def encode(self, text: str) -> Iterator[list[int]]:
        """The text's ids, block by block."""
        for part, special in self.parts(text):
            if special:
                yield [self.special[part]]
                continue
            if len(part) <= PART:
                found = iter(self.pattern.findall(part))
            else:  # no cut in it: its pieces are found as they are needed
                found = (m.group() for m in self.pattern.finditer(part))
            while some := list(islice(found, self.params.pieces)):
                yield list(chain.from_iterable(map(self.known.__getitem__, some)))

    def decode(self, blocks: Iterator[list[int]]) -> Iterator[str]:
        """Text from ids; what bytes of a character are still to come waits in the state machine."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield state.decode(b"".join(map(self.bytes.__getitem__, ids)))
        yield state.decode(b"", True)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

        def blocks() -> Iterator[list[int]]:
            nonlocal n
            for ids in self.encode(text):
                if ids:
                    ids_hash.update((("," if n else "") + ",".join(map(self.names.__getitem__, ids))).encode())
                    n += len(ids)
                    yield ids

        for said in self.decode(blocks()):
            text_hash.update(said.encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


class _Known(dict):
    """Tokens of pieces seen lately; long pieces are not kept."""

    def __init__(self, t: Transducer):
        super().__init__()
        self.t = t

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if len(data) > 100:
            return tuple(self.t.stream(iter(data)))
        ids = tuple(self.t.merge([self.t.byte_id[b] for b in data]))  # all of it fits the buffer
        if len(data) <= 64:
            if len(self) >= self.t.params.cached:
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[BpeParams, Transducer] = {}


def transducer(p: BpeParams) -> Transducer:
    """One for each worker process and parameters."""
    if p not in _loaded:
        _loaded[p] = Transducer(p)
    return _loaded[p]


def bpe_digests(docs: DataFrame, p: BpeParams) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""

    def of(batches):
        import pyarrow as pa

        t = transducer(p)
        for batch in batches:
            rows = [t.digest(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
