"""Spelling variants, the BPE codec and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatloom.llm import bpe_codec as B
from chatloom.llm import importance as I
from chatloom.llm import spelling as S
from chatloom.llm.catalog import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, "Colour colour COLOUR color color color color color color"), (1, "Colour colour COLOUR color color color color color color"), (2, None), (3, ""), (None, "colours colours colours Éclair éclair éclair éclairs"), (None, None), (4, "x" * 70_000 + " " + "xy" * 60_000), (5, " \n\t "), (6, "a <|endoftext|> b<|endoftext|>"), (7, "\U0001f600 中文 ՘ ­ ​x\x85y")]


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("n", "word", "m", "back", "half", "ids", "bucket", "weight", "score", "rank", "n_words"):
        rows = rows.withColumn(c, F.lit("clash"))
    return rows


# --- spelling variants


def _plain_spelling(rows, least_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least_count}
    near = defaultdict(set)
    places = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cut = w[:k] + w[k + 1 :]
            places[k, cut].add(w)
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
    for own in places.values():
        for w in own:
            near[w] |= own - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling_equals_a_plain_version(spark, sf):
    rows = [tuple(r) for r in _docs(spark, sf).select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_spelling_variants"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == _plain_spelling(rows)
    assert any(form for _, form, *_ in got)


def test_spelling_in_blocks_and_on_odd_rows(spark):
    r = random.Random(3)
    many = [(k, " ".join(["stemm" + "".join(r.choices("abé", k=r.randrange(1, 5)))] * r.randrange(1, 9))) for k in range(400)]
    rows = ODD[:6] + ODD[7:] + many
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    want = _plain_spelling(rows)
    for block in (1 << 12, 7):
        assert {tuple(r) for r in S.spelling_groups(table, block=block).collect()} == want
    assert max(x[4] for x in want) > 10
    long = {r["word"]: r for r in S.spelling_groups(spark.createDataFrame([(1, "y" * 70_001), (2, "y" * 70_000), (3, "z" + "y" * 69_999)], "doc_id long, text string"), least_count=1, modulus=1 << 40).collect()}
    assert {len(w): r["n_near"] for w, r in long.items() if w[0] == "y"} == {70_001: 1, 70_000: 2}


def test_the_count_filter_keeps_every_edit():
    r = random.Random(5)
    for _ in range(300):
        m = r.randrange(5, 11)
        base = "".join(r.choices("ab", k=m))
        words = {base}
        for _ in range(12):
            k = r.randrange(m + 1)
            words |= {base[:k] + r.choice("abc") + base[k:], base[: k - 1] + r.choice("abc") + base[k:] if k else base}
        words = sorted(w for w in words if len(w) in (m, m + 1))
        dealt = defaultdict(list)
        for w in words:
            for size in (len(w), len(w) - 1):
                dealt[size, False, w[: size // 2]].append(w)
                dealt[size, True, w[::-1][: size - size // 2]].append(w[::-1])
        got = Counter()
        for (size, back, _), own in dealt.items():
            for a, b in S.near_pairs(size, back, own):
                got[frozenset((own[a][::-1], own[b][::-1]) if back else (own[a], own[b]))] += 1
        near = lambda a, b: len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:k] + max(a, b, key=len)[k + 1 :] == min(a, b, key=len) for k in range(len(max(a, b, key=len))))
        assert got == {frozenset((a, b)): 1 for a in words for b in words if a < b and near(a, b)}


def test_roots_follow_long_chains_and_meet(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [(f"v{k}", "w5") for k in range(50)]
    got = {r["word"]: r["root"] for r in S.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {a: "w37" for a, _ in links}


# --- BPE codec


def _hashes(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_codec_equals_the_library(spark, sf):
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted(_hashes(library, *r) for r in _docs(spark, sf).select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in QUERIES["op12_bpe_round_trip"](spark, sf).collect()) == want


def test_codec_on_odd_rows(spark):
    library = Tokenizer.from_file(VOCABULARY)
    both = B.decoded(B.encoded(_odd(spark))).collect()
    assert both[0].__fields__ == ["doc_id", "ids", "text"]
    assert sorted((str(r["doc_id"]), r["ids"], r["text"]) for r in both) == sorted((str(k), library.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in ODD)
    odd = spark.createDataFrame([(1, [15496, None, 99_999_999, 995]), (2, None), (3, []), (4, [447]), (None, [50256])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in B.decoded(odd).collect()}
    assert got == {1: library.decode([15496, 995]), 2: "", 3: "", 4: library.decode([447]), None: "<|endoftext|>"}


def test_codec_on_random_texts():
    library, own, r = Tokenizer.from_file(VOCABULARY), B.Codec("byte_bpe_50k.json"), random.Random(7)
    pool = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "中", "՘", "😀", "<|endoftext|>", "\x85", "\xa0", "\x1c", "Ġ", "​", "ing", "the", "\t", "ﬁ", "́", "<|", "\U0001e030"]
    texts = ["".join(r.choices(pool, k=r.randrange(40))) for _ in range(3000)] + ["a" * 5000, "ab" * 700, "x" * 77 + " " * 500 + "y", "é" * 999]
    for text in texts:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for _ in range(500):
        ids = [r.randrange(50_300) for _ in range(r.randrange(9))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    fragments = own.fragments("the qzxß end".encode())
    assert b"".join(fragments) == "the qzxß end".encode() and len(fragments) > 1
    own.memory.clear()
    assert own.encode(" word" * 400_000).tolist() == library.encode(" word" * 400_000, add_special_tokens=False).ids


# --- importance resampling


def _plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def _plain_resampling(docs, target):
    raw, wanted = Counter(), Counter()
    for _, text in docs:
        raw.update(_plain_features(text)[1])
    for text in target:
        wanted.update(_plain_features(text)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[k] + 1) * (s + 10_000) / ((raw[k] + 1) * (t + 10_000)))) for k in range(10_000)]
    rows = []
    for doc_id, text in docs:
        n, own = _plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: 5 * len(enough) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resampling_equals_a_plain_version(spark, sf):
    docs = [tuple(r) for r in _docs(spark, sf).select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = [tuple(r) for r in QUERIES["op13_importance_resampling"](spark, sf).collect()]
    assert sorted(got, key=str) == _plain_resampling(docs, target)
    assert sum(r[4] is not None for r in got) == 5 * sum(_plain_features(t)[0] >= 20 for _, t in docs) // 100 > 0


@pytest.mark.parametrize("least_words", [20, 1])
def test_resampling_on_odd_rows(spark, least_words):
    rows = _odd(spark)
    got = {str(r["doc_id"]): r for r in I.resampled(rows, spark.createDataFrame([("colour éclair",), (None,)], "text string"), percent=100, least_words=least_words).collect()}
    assert all(got[k]["weight"] == 0 and got[k]["n_features"] == 0 and got[k]["rank"] is None for k in ("2", "3", "5"))
    every = I.resampled(rows, spark.createDataFrame([], "text string"), percent=100, least_words=least_words).collect()
    ranks = sorted(r["rank"] for r in every if r["rank"] is not None)
    assert len(every) == len(ODD) and ranks == list(range(1, 1 + sum(_plain_features(t)[0] >= least_words for _, t in ODD)))


def test_tries_do_not_depend_on_their_ends(monkeypatch):
    r = random.Random(11)
    texts = [" ".join(r.choices(["a", "Bb", "c1", "é", "a"], k=r.randrange(60))) for _ in range(60)] + ["", "word " * 5000]
    want = [_plain_features(t) for t in texts]
    totals, gains = Counter(b for _, own in want for b in own), np.arange(10_000) - 5000.0
    for piece, words in ((1 << 22, 1 << 19), (40, 30), (1, 1)):
        monkeypatch.setattr(I, "PIECE_BYTES", piece)
        monkeypatch.setattr(I, "TRIE_WORDS", words)
        tries = list(I.tries(texts))
        assert sum(t.totals(10_000) for t in tries).tolist() == [totals[k] for k in range(10_000)]
        weight, n, words_found = sum(np.stack(t.weights(gains, len(texts))) for t in tries)
        assert weight.tolist() == [sum(int(gains[b]) for b in own) for _, own in want]
        assert n.tolist() == [len(own) for _, own in want] and words_found.tolist() == [k for k, _ in want]
