"""Packing into fixed-length sequences: first-fit decreasing with a tournament tree.

Documents are dealt to randomised groups by a hash; the number of groups follows both the
rows and the characters, so a group's size does not grow with the table. Each group is
tokenised and packed by one task on its own: whole sequences are cut from long
documents, the rest goes first-fit decreasing, where a tournament tree over the free
room of the bins finds the first bin that fits in logarithmic time. Last, the emptiest
bins are cut up to fill the room left in the others.

Defined cases: a null or empty text is the end token alone; a null doc_id stays null;
repeated rows are packed as often as they occur; documents of one length go by their place in
the group; a text longer than a sequence is cut; an empty table gives no rows. Extra columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import documents

LENGTH, END_ID = 2048, 1
#: A group holds about this many documents or characters, whichever is reached first.
GROUP_ROWS, GROUP_CHARS = 2048, 32_000_000
#: Room under this many tokens stays padding rather than taking a cut of a document.
LEAST_CUT = 16
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Free room of bins in order; first(need) is the leftmost bin with that room."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        most, at = self.most, 1
        while at < self.size:
            at *= 2
            if most[at] < need:
                at += 1
        return at - self.size

    def take(self, bin_: int, n: int) -> None:
        most, at = self.most, bin_ + self.size
        most[at] -= n
        while at > 1:
            at //= 2
            now = max(most[2 * at], most[2 * at + 1])
            if most[at] == now:
                break
            most[at] = now


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indexes into sizes; each size is 1 to capacity."""
    tree, bins = TournamentTree(max(1, len(sizes)), capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = tree.first(sizes[k])
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
        tree.take(at, sizes[k])
    return bins


def pack(lengths: list[int], capacity: int = LENGTH, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of these lengths."""
    out, rest = [], []
    for doc, n in enumerate(lengths):
        out += [[(doc, at, capacity)] for at in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rest.append((doc, n - n % capacity, n % capacity))
    bins = [[rest[k] for k in b] for b in first_fit_decreasing([x[2] for x in rest], capacity)]
    # A heap of (load, bin): the emptiest is cut up as long as the others have the room.
    load = [sum(x[2] for x in b) for b in bins]
    donors = [(n, k) for k, n in enumerate(load)]
    heapq.heapify(donors)
    gaps = sorted((k for k in range(len(bins)) if capacity - load[k] >= least_cut), key=lambda k: (-load[k], k))
    room, at, gone = sum(capacity - load[k] for k in gaps), 0, set()
    while donors and at < len(gaps):
        n, k = heapq.heappop(donors)
        if n != load[k] or room - (capacity - n) < n:
            break
        gone.add(k)
        room -= capacity - n + n
        for doc, start, size in bins[k]:
            while size:
                while gaps[at] in gone or capacity - load[gaps[at]] == 0:
                    at += 1
                to = gaps[at]
                cut = min(size, capacity - load[to])
                bins[to].append((doc, start, cut))
                load[to] += cut
                start, size = start + cut, size - cut
        bins[k] = []
    return out + [b for b in bins if b]


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """Text -> ids of a byte-level BPE in a tokenizers .json, by its .tiktoken ranks beside it (same ids, several times faster).

    Strings of the added tokens of the .json are those tokens wherever they stand in a text.
    """
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(vocabulary)
    with open(path, encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    found = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        return found.encode(text, allowed_special="all") if any(x in text for x in added) else found.encode_ordinary(text)

    return encode


def _pack_group(vocabulary: str, capacity: int, end_id: int):
    def run(group: pa.Table) -> pa.Table:
        encode = encoder(vocabulary)
        rows = sorted(zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
        ids = [np.array([*encode(text or ""), end_id], dtype="<u4") for _, text in rows]
        base = group.column("grp")[0].as_py() << 32
        out: list[tuple] = []
        for k, pieces in enumerate(pack([len(x) for x in ids], capacity)):
            offset = 0
            for doc, start, n in pieces:
                out.append((rows[doc][0], start, n, zlib.crc32(ids[doc][start : start + n]), len(ids[doc]), base + k, offset))
                offset += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, zip(*out, strict=True), strict=True)})

    return run


def packed(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = LENGTH, end_id: int = END_ID,
    group_rows: int = GROUP_ROWS, group_chars: int = GROUP_CHARS, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row a piece. Groups hold about group_rows documents or group_chars characters.

    The hash takes a row's place in its partition too, so that copies of one row, or many
    rows without an id, spread over all groups. docs should be a scan, whose partitions are the
    same when a lost task is run again.
    """
    dealt = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = dealt.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    groups = max(1, -(-size["n"] // group_rows), -(-size["chars"] // group_chars))
    dealt = dealt.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(11)), F.lit(groups)).cast("long"))
    return dealt.groupBy("grp").applyInArrow(_pack_group(vocabulary, capacity, end_id), PIECE)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
