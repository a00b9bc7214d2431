"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams in order. A document's own
list is compared to each profile by out-of-place distance: the sum of the differences
in rank, with the profile's length for an n-gram that it lacks. The nearest language
wins; ties go to the first name.

N-grams of 1 to 4 characters are taken inside words, with one blank at either end; a
character is its code point folded to 15 bits. Defined cases: a text that is null or has
no letter is `und` with score 0; with nothing to learn from, every text is; null languages
teach nothing; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.common import documents, per_slice, remainder_is

PROFILE = 400
LONGEST = 4
FOLD = 15
#: A profile is learned from about this many documents of a language, chosen by a hash of
#: their ids. Prediction reads every text whole.
TEACHERS = 3000
UNKNOWN = "und"
#: Characters worked on at once; a character takes some hundred bytes on the way.
SLICE = 400_000
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Code point -> 0 for what is no letter, else the folded code from 1."""
    table = np.zeros(0x110000, np.uint16)
    every = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    points = np.nonzero(every)[0]
    table[points] = points % ((1 << FOLD) - 1) + 1
    return table


def grams(texts: list[str], longest: int = LONGEST) -> list[np.ndarray]:
    """For each text the sorted n-gram codes, repeats included."""
    lowered = [x.lower() for x in texts]
    flat = np.frombuffer("".join(f" {x} " for x in lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter((len(x) + 2 for x in lowered), np.int64, len(lowered))
    code = _codes()[flat].astype(np.int64)
    keep = code > 0
    keep[0] = True
    keep[1:] |= code[:-1] > 0
    begin = np.concatenate(([0], np.cumsum(size)))
    keep[begin[:-1]] = True  # a blank parts each text from the one before
    at = np.concatenate(([0], np.cumsum(keep)))[begin]
    code = code[keep]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    key, inner = code.copy(), np.ones(len(code), bool)
    found.append((np.nonzero(code)[0], key[code > 0]))
    for n in range(2, longest + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        key = (key[:m] << FOLD) | code[n - 1 :]
        inner = (inner[:m] & (code[n - 2 : n - 2 + m] > 0)) if n > 2 else np.ones(m, bool)
        # Blanks that end one text and begin the next are neighbours, never inside a word.
        ok = inner if n > 2 else (code[:m] > 0) | (code[1:] > 0)
        where = np.nonzero(ok)[0]
        found.append((where, key[where] | (n << (FOLD * 4))))
    cuts = [np.searchsorted(where, at) for where, _ in found]
    return [np.sort(np.concatenate([k[c[d] : c[d + 1]] for (_, k), c in zip(found, cuts, strict=True)])) for d in range(len(texts))]


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The `most` most frequent codes, by count and then by code."""
    if not len(codes):
        return codes
    edge = np.nonzero(np.concatenate(([True], codes[1:] != codes[:-1])))[0]
    count = np.diff(np.concatenate((edge, [len(codes)])))
    if len(edge) > most:
        least = np.partition(count, len(count) - most)[len(count) - most]
        edge, count = edge[count >= least], count[count >= least]
    return codes[edge[np.argsort(-count, kind="stable")[:most]]]


def _count_grams(rows: pa.RecordBatch, texts: list[str]) -> dict:
    langs = np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), dtype=object)
    found = grams(texts)
    out: dict = {"lang": [], "gram": [], "n": []}
    for lang in sorted(set(langs)):
        codes, count = np.unique(np.concatenate([found[k] for k in np.nonzero(langs == lang)[0]]), return_counts=True)
        out["lang"] += [lang] * len(codes)
        out["gram"] += codes.tolist()
        out["n"] += count.tolist()
    return out


def learn_profiles(docs: DataFrame, teaches: Column, length: int = PROFILE, teachers: int = TEACHERS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """Language -> n-gram codes by rank, from documents for which `teaches` holds."""
    rows = docs.filter(teaches & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.lit(teachers * (1 << 20)) / F.col("rows")
    chosen = rows.join(F.broadcast(sizes), "lang").filter(share).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    counts = chosen.mapInArrow(per_slice(_count_grams, schema), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = _top(counts, length)
    return {r["lang"]: list(r["grams"]) for r in sorted(top.collect(), key=lambda r: r["lang"])}


def _top(counts: DataFrame, length: int) -> DataFrame:
    """First the best of each of 64 parts of a language, then the best of those."""
    spread = counts.withColumn("part", F.pmod(F.hash("gram"), F.lit(64)))
    best = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= length)
    first = best(spread, "lang", "part").drop("k", "part")
    return best(first, "lang").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "gram"))), lambda x: x["gram"]).alias("grams"))


def _predict(profiles: dict[str, list[int]], length: int):
    langs = sorted(profiles)
    known = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in langs])) if langs else np.zeros(0, np.int64)
    rank = np.full((len(known) + 1, max(1, len(langs))), length, np.int32)  # the last row: no profile has it
    for k, lang in enumerate(langs):
        rank[np.searchsorted(known, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def run(rows: pa.RecordBatch, texts: list[str]) -> dict:
        pred, score = [], []
        for codes in grams(texts):
            top = ranked(codes, length)
            if not len(top) or not langs:
                pred.append(UNKNOWN)
                score.append(0.0)
                continue
            at = np.searchsorted(known, top)
            at[at == len(known)] = 0
            near = rank[np.where(known[at] == top, at, len(known))]
            far = np.where(near == length, length, np.abs(near - np.arange(len(top))[:, None])).sum(0)
            pred.append(langs[int(np.argmin(far))])
            score.append(1.0 - float(far.min()) / (length * len(top)))
        return {"doc_id": rows.column(0) if rows else None, "lang_pred": pred, "score": score}

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]], length: int = PROFILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; score is 1 less the mean distance a n-gram over the worst."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(per_slice(_predict(profiles, length), _OUT, most_chars=SLICE), "doc_id long, lang_pred string, score double")


def in_known_language(profiles: dict[str, list[int]], least: float, length: int = PROFILE):
    """A test for texts: the prediction is a language, with this score or more."""
    predict = _predict(profiles, length)

    def keeps(texts: list[str]) -> np.ndarray:
        found = predict(None, texts)
        return np.array([lang != UNKNOWN and score >= least for lang, score in zip(found["lang_pred"], found["score"], strict=True)], bool)

    return keeps


def teaching_rows() -> Column:
    return ~remainder_is(F.col("doc_id"), 4, 2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, learn_profiles(docs, teaching_rows()))
    return found.select("doc_id", remainder_is(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
