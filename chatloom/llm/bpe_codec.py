"""Byte-level BPE encoding by forced boundaries, and decoding.

Some pairs of bytes stand side by side in no token of the vocabulary. Between two such bytes no
merge can ever reach across, so every place of such a pair is a certain cut: the fragments between cuts
are encoded on their own and their ids put one after another. Cuts are taken inside the
pieces of the vocabulary's own split pattern, as the pattern looks ahead over pairs. Long fragments
are merged by rank with a heap, so n bytes take n log n steps; pieces seen before in a task come
from a memory of bounded size.

The split pattern needs the Unicode version of the vocabulary's own library only for code points that
are not assigned in Unicode 15.1; texts that have one are split by that library.

Defined cases: a null or empty text has no ids and decodes to an empty text, as null or empty ids do; ids
that the vocabulary lacks and nulls among ids are left out in decoding; strings of added tokens are those tokens wherever
they stand; bytes that are no UTF-8 decode to U+FFFD; equal rows give equal rows and there are no ties (of equal ranks
the left pair goes first); a very long text is split in runs of pieces; an empty table gives no rows; only the columns asked for are kept,
so that others may have any name.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import bounded_batches, documents, slices

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a task remembers twice over, and the longest of them.
REMEMBERED, LONGEST = 1 << 19, 64
#: Fragments up to so many bytes are merged by looking through all pairs, longer ones with a heap.
SHORT = 32
#: Pieces of a long text that are held at once.
RUN = 1 << 16


def _letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: visible Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranges(wanted: Callable[[str], bool], first: int, stop: int) -> str:
    """The code points from first to stop that are wanted, as ranges of a character class."""
    out, start = [], None
    for c in range(first, stop + 1):
        if c < stop and wanted(chr(c)):
            start = c if start is None else start
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: Below this code point all characters are assigned, and few enough for classes spelled out.
LATE = 0x378


def _early(pattern: str) -> re.Pattern:
    """The split pattern for texts without a character from LATE on, in the plain engine, which knows no classes of Unicode."""
    kind = {x: _ranges(lambda c, x=x: unicodedata.category(c)[0] == x, 0, LATE) for x in "LN"}
    space = _ranges(lambda c: bool(regex.match(r"\s", c)), 0, LATE)
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{kind['L']}{kind['N']}]")
    for name, chars in ((r"\p{L}", kind["L"]), (r"\p{N}", kind["N"]), (r"\s", space)):
        inside = inside.replace(name, f"[{chars}]")
    return re.compile(inside.replace(r"\S", f"[^{space}]"))


class Codec:
    """Text to ids and back. One a worker; not thread safe."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tokenizers

        path = public_tokenizers.path(vocabulary)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _letters()
        raw = lambda token: bytes(byte[x] for x in token)
        ids = {raw(t): k for t, k in spec["model"]["vocab"].items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        #: (left id, right id) -> rank, and the id of both by rank.
        self.merges: dict[tuple[int, int], int] = {}
        self.both: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[ids[a], ids[b]] = rank
            self.both.append(ids[a + b])
        #: 1 where the two bytes stand side by side in some token.
        self.inside = bytearray(1 << 16)
        for token in ids:
            for a, b in zip(token, token[1:], strict=False):
                self.inside[a << 8 | b] = 1
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = {k: t for t, k in ids.items()} | {k: t.encode() for t, k in self.added.items()}
        self.marks = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.early = _early(public_tokenizers.PATTERN)
        unassigned = _ranges(lambda c: unicodedata.category(c) == "Cn", LATE, 0x110000)
        self.late, self.unassigned = re.compile(f"[{chr(LATE)}-\U0010ffff]"), regex.compile(f"[{unassigned}]")
        self.splitter = tokenizers.Tokenizer.from_file(path).pre_tokenizer
        #: Pieces seen of late, and those seen before them.
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece cut wherever two bytes never meet inside a token."""
        inside = self.inside
        cuts = [k for k, (a, b) in enumerate(pairwise(piece), 1) if not inside[a << 8 | b]]
        return [piece[a:b] for a, b in pairwise([0, *cuts, len(piece)])] if cuts else [piece]

    def merged(self, fragment: bytes) -> list[int]:
        """The ids of one fragment: the pair of least rank, the leftmost of equals, is merged until none is left."""
        ids = [self.single[b] for b in fragment]
        return self._by_scan(ids) if len(ids) <= SHORT else self._by_heap(ids)

    def _by_scan(self, ids: list[int]) -> list[int]:
        merge, both, none = self.merges.get, self.both, len(self.both)
        ranks = [merge(x, none) for x in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k] = own = both[best]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = merge((own, ids[k + 1]), none)
            if k:
                ranks[k - 1] = merge((ids[k - 1], own), none)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        merge, both, n = self.merges.get, self.both, len(ids)
        heap = [(rank, k, k + 1) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if (rank := merge(pair)) is not None]
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, left, right = heapq.heappop(heap)
            # Ids at both places must still be those that were pushed; a place merged away holds -1.
            if ids[left] < 0 or after[left] != right or merge((ids[left], ids[right])) != rank:
                continue
            ids[left], ids[right] = both[rank], -1
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (more := merge((ids[left], ids[nxt]))) is not None:
                    heapq.heappush(heap, (more, left, nxt))
            if (prev := before[left]) >= 0 and (more := merge((ids[prev], ids[left]))) is not None:
                heapq.heappush(heap, (more, prev, left))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece as numbers of 32 bits."""
        if (found := self.older.get(piece)) is None:
            found = array("i", [x for f in self.fragments(piece.encode()) for x in self.merged(f)]).tobytes()
        if len(piece) <= LONGEST:
            if len(self.memory) >= REMEMBERED:
                self.older = dict(self.memory)
                self.memory.clear()
            self.memory[piece] = found
        return found

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text without added tokens, in runs."""
        late = self.late.search(text)
        pattern = self.pattern if late else self.early
        if late and self.unassigned.search(text):
            yield [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        elif len(text) <= 16 * RUN:
            yield pattern.findall(text)
        else:
            yield from map(list, batched((m.group() for m in pattern.finditer(text)), RUN))

    def encode(self, text: str) -> np.ndarray:
        out, at, known = [], 0, self.memory
        for mark in [*(self.marks.finditer(text) if self.marks else ()), None]:
            stop = mark.start() if mark else len(text)
            for run in self.pieces(text[at:stop] if at or mark else text) if stop > at else ():
                out.append(b"".join([known.get(x) or self._piece(x) for x in run]))
            if mark:
                out.append(np.array([self.added[mark.group()]], np.intc).tobytes())
                at = mark.end()
        return np.frombuffer(b"".join(out), np.intc)

    def decode(self, ids: list[int | None]) -> str:
        return b"".join([self.bytes.get(x, b"") for x in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def encoded(rows: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids), one row for every row; nothing is shuffled."""
    bounded_batches(rows.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(vocabulary).encode
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids = [encode(x) for x in texts]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, np.concatenate(ids))], schema=schema)

    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text), one row for every row; nothing is shuffled."""
    bounded_batches(rows.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(vocabulary).decode
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = pa.array([decode(x.as_py() or []) if not isinstance(x.values, pa.Int32Array) or x.values.null_count else decode(x.values.to_numpy().tolist()) for x in part.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], schema=schema)

    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decoded(encoded(documents(spark, sf_dir)))
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
