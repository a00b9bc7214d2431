"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Two words one insertion, deletion or replacement apart agree in the first half or in the last half of the
shorter one. So the index is dealt by halves: a word of length l lies in the parts of its first and its last
half, once for a shorter length of l and once for l - 1, and every pair meets in a part where both lengths
and one half are given. In a part, words become padded 2-grams by place behind the shared half (last halves are read backwards). The
edit lies behind the half, so a gram that it leaves whole stands at the same place, or one later in a longer word:
these are the length and position limits of the posting lists. One edit breaks at most two
grams of equally long words and one of the shorter of unequal ones, which bounds the shared grams from below. The shortest lists of a word
are merged with a heap, the rest is looked up by bisection, words with fewer shared grams than the bound go, and what stays is verified.
A pair that agrees in both halves counts where it shares the first one.

A part of over BLOCK words is dealt into blocks, of which every two meet in a unit of their own; nothing is left out. Units send
one row a word with its count of near words and the best of them, never pairs.

Defined cases: null and empty texts have no words; a null id is an empty text in the hash that deletes a
code point; repeated rows count again; of near words with the largest count the smallest in code-point order is the form;
a run of any length is one word, a long text is read whole; an empty table gives no rows; extra columns are ignored and may have any name.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import bounded_batches, documents, slices
from chatloom.session import staged

LEAST_LENGTH, LEAST_COUNT, MODULUS, TIMES = 5, 3, 97, 2
#: Distinct words that a task holds before it sends their counts, and words of a part before it is dealt into blocks.
HELD, BLOCK = 1 << 18, 1 << 12
#: A byte a code point up to U+00FF: ASCII letters lower-cased, U+00C0 to U+00FF kept, the rest parts words.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def spelled(doc_id: int | None, text: str, modulus: int = MODULUS) -> Counter[bytes]:
    """The words of a text, in Latin-1, with a code point deleted where the hash of id and run says so."""
    own, out = Counter(text.encode("latin-1", "replace").translate(_RUNS).split()), Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in own.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % modulus == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = MODULUS) -> DataFrame:
    """(word, n) of all words long and frequent enough."""
    bounded_batches(docs.sparkSession)

    def sent(held: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                for doc_id, own in zip(part.column(0).to_pylist(), texts, strict=True):
                    for word, n in spelled(doc_id, own, modulus).items():
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= HELD:
                    yield sent(held)
                    held = Counter()
        yield sent(held)

    each = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def parts(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(m, back, half, text, n): each word in its parts; m is the length of the shorter word there, text is backwards where the last half is shared."""
    size, out = F.length("word"), words
    own = [F.struct(m.cast("int").alias("m"), F.lit(back).alias("back")) for m in (size, size - 1) for back in (False, True)]
    out = out.select("word", "n", F.explode(F.filter(F.array(*own), lambda x: x["m"] >= least_length)).alias("at")).select("word", "n", "at.*")
    out = out.withColumn("text", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    return out.select("m", "back", F.substring(F.col("text"), F.lit(1), shared("m", "back")).alias("half"), "text", "n")


def shared(m: str, back: str) -> Column:
    """Length of the half that a part shares."""
    first = F.floor(F.col(m) / 2).cast("int")
    return F.when(F.col(back), F.col(m) - first).otherwise(first)


def one_edit(a: str, b: str, start: int) -> bool:
    """b is a with one code point replaced, or one more; both agree before start."""
    at = start
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


class Postings:
    """The posting lists of one part behind the shared half: (2-gram, place, length) -> numbers of words, rising."""

    def __init__(self, m: int, start: int, texts: list[str]):
        self.m, self.start, self.texts = m, start, texts
        self.lists: defaultdict[tuple[str, int, int], list[int]] = defaultdict(list)
        for k, text in enumerate(texts):
            for gram in self._grams(text):
                self.lists[*gram, len(text)].append(k)

    def _grams(self, text: str) -> list[tuple[str, int]]:
        tail = text[self.start - 1 :] + "\0"
        return [(tail[k : k + 2], k) for k in range(len(tail) - 1)]

    def candidates(self, k: int) -> Iterator[int]:
        """Words of length m + 1, and of length m after k, that share enough grams with word k of length m."""
        get, grams, tail = self.lists.get, self._grams(self.texts[k]), self.m - self.start
        same = [x[bisect_left(x, k + 1) :] if x[0] <= k else x for g, p in grams if (x := get((g, p, self.m)))]
        yield from self._merged(same, tail - 1, len(grams))
        longer = [[x for j in (p, p + 1) if (x := get((g, j, self.m + 1)))] for g, p in grams]
        yield from self._merged([x[0] if len(x) == 1 else list(heapq.merge(*x)) for x in longer if x], tail, len(grams))

    @staticmethod
    def _merged(lists: list[list[int]], least: int, grams: int) -> Iterator[int]:
        """Numbers that stand in `least` of the lists. Whatever stands in so many is in one of the `short` shortest."""
        if len(lists) < least:
            return
        lists.sort(key=len)
        short = len(lists) - least + 1
        for number, run in groupby(heapq.merge(*lists[:short]) if short > 1 else lists[0]):
            found = sum(1 for _ in run)
            for k, x in enumerate(lists[short:], short):
                if found >= least or found + len(lists) - k < least:
                    break
                at = bisect_left(x, number)
                found += at < len(x) and x[at] == number
            if found >= least:
                yield number


def near_pairs(m: int, back: bool, texts: list[str], sides: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of numbers of near words in one part. With sides, only pairs of words from both sides."""
    first = m // 2
    start = m - first if back else first
    if all(len(x) > m for x in texts):
        return
    index = Postings(m, start, texts)
    for a, text in enumerate(texts):
        if len(text) != m:
            continue
        for b in index.candidates(a):
            other = texts[b]
            if (sides is None or sides[a] != sides[b]) and one_edit(text, other, start) and not (back and text[-first:] == other[-first:]):
                yield a, b


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _unit(m: int, back: bool, split: bool, texts: list[str], counts: list[int], sides: list[int], out: list[list]) -> None:
    near: dict[int, tuple[int, tuple]] = {}
    for a, b in near_pairs(m, back, texts, sides if split else None):
        for x, y in ((a, b), (b, a)):
            n, best = near.get(x, (0, (1, "")))
            near[x] = n + 1, min(best, (-counts[y], texts[y][::-1] if back else texts[y]))
    for x, (n, (best_n, best)) in near.items():
        for column, value in zip(out, (texts[x][::-1] if back else texts[x], n, -best_n, best), strict=True):
            column.append(value)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; one unit is held at a time."""
    key, held = None, ([], [], [])
    for batch in batches:
        out: list[list] = [[], [], [], []]
        unit = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
        for own, rows in groupby(zip(unit, *(batch.column(k).to_pylist() for k in (5, 6, 7)), strict=True), key=lambda x: x[0]):
            if own != key:
                if len(held[0]) > 1:
                    _unit(key[0], key[1], key[3] != key[4], *held, out)
                key, held = own, ([], [], [])
            for _, text, n, side in rows:
                held[0].append(text)
                held[1].append(n)
                held[2].append(side)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _NEAR, strict=True)], schema=_NEAR)
    if len(held[0]) > 1:
        _unit(key[0], key[1], key[3] != key[4], *held, out := [[], [], [], []])
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _NEAR, strict=True)], schema=_NEAR)


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of each word with a near word; best has the largest count, of equals it is the smallest."""
    unit = ["m", "back", "half", "low", "high"]
    rows = parts(words, least_length)
    large = rows.groupBy("m", "back", "half").agg(F.count("*").alias("rows")).filter(F.col("rows") > block)
    large = staged(large.select("m", "back", "half", F.ceil(F.col("rows") / block).cast("int").alias("blocks")))
    # Of large parts there are at most 4 * words / block.
    rows = rows.join(large, ["m", "back", "half"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("m", "back", "half", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "text", "n", "own")
    found = rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_units, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("down"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.down")).alias("best_n"), F.col("x.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without circles: each round doubles the steps taken."""
    now = staged(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.filter("moved").limit(1).count():
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = staged(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return now.select("word", "root")


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = MODULUS, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for every word."""
    words = staged(word_counts(docs, key, text, least_length, least_count, modulus))
    is_form = F.col("best_n") >= times * F.col("n")
    near = staged(words.join(near_words(words, least_length, block), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    found = near.join(roots(near.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))
