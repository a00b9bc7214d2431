import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import pipeline as K
from chatloom.llm import decontamination as D
from chatloom.llm import language_id as L
from chatloom.llm import near_copies as N
from chatloom.llm import packing as P
from chatloom.llm import pitman_yor as H
from chatloom.llm import quality_classifier as Q
from chatloom.llm import simhash as S
from chatloom.llm import token_counts as C
from chatloom.llm import toxicity as X
from chatloom.llm.catalog import ORACLE_SQL, QUERIES
from tests.compare import same_rows


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, sf, name):
    assert same_rows(spark, QUERIES[name], ORACLE_SQL[name], sf) > 0


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- packing


def test_tree_finds_the_first_fit():
    r = random.Random(1)
    for _ in range(30):
        sizes = [r.randrange(1, 101) for _ in range(r.randrange(1, 80))]
        bins, load = [], []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            at = next((b for b in range(len(bins)) if load[b] + sizes[k] <= 100), len(bins))
            if at == len(bins):
                bins.append([])
                load.append(0)
            bins[at].append(k)
            load[at] += sizes[k]
        assert P.first_fit_decreasing(sizes, 100) == bins


def test_packing_spreads_copies_of_one_row_and_long_texts(spark):
    rows = spark.createDataFrame([(None, "")] * 300 + [(1, "the same words")] * 300, "doc_id long, text string").repartition(3)
    pieces = P.packed(rows, group_rows=100).collect()
    assert len({r.sequence_id >> 32 for r in pieces}) == 6 and sum(r.doc_id is None for r in pieces) == 300
    most = max(sum(1 for r in pieces if r.sequence_id >> 32 == g) for g in range(6))
    assert most < 200
    long = spark.createDataFrame([(k, "word " * 200) for k in range(50)], "doc_id long, text string")
    assert len({r.sequence_id >> 32 for r in P.packed(long, group_chars=10_000).collect()}) > 2


def test_packing_is_an_exact_round_trip(spark, sf):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in _docs(spark, sf).collect()}
    rows = QUERIES["op1_packing"](spark, sf).collect()
    used, load = {k: np.zeros(len(v), int) for k, v in want.items()}, Counter()
    for r in rows:
        own = want[r["doc_id"]]
        used[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        load[r["sequence_id"]] += r["length"]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]])
    assert all((u == 1).all() for u in used.values()) and max(load.values()) <= 2048
    for s in load:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    assert sum(2048 - n for n in load.values()) < 0.02 * sum(load.values())


def test_ids_are_those_of_tokenizers_where_added_tokens_stand():
    from tokenizers import Tokenizer

    import public_tokenizers

    t, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    bits = ["<|endoftext|>", " ", "a", "\n", "<|endof", "text|>", "Über ", "don't", "  ", "12", "\U0001f600"]
    for _ in range(300):
        text = "".join(r.choices(bits, k=r.randrange(12)))
        assert P.encoder("byte_bpe_50k.json")(text) == t.encode(text, add_special_tokens=False).ids, text


# --- language


def test_profiles_equal_a_plain_count():
    texts = ["Ça va bien, l'été arrive. Bien!", "été"]
    code = lambda c: ord(c) % ((1 << L.FOLD) - 1) + 1
    for text, got in zip(texts, L.grams(texts), strict=True):
        plain = Counter()
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = [0, *map(code, word), 0]
            for n in range(1, 5):
                for k in range(len(padded) - n + 1):
                    own = padded[k : k + n]
                    if any(own) and (n > 1 or own[0]):
                        value = 0
                        for c in own:
                            value = value << L.FOLD | c
                        plain[value | (n << (L.FOLD * 4) if n > 1 else 0)] += 1
        assert Counter(got.tolist()) == plain


def test_held_out_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_language_id"](spark, sf).join(_docs(spark, sf).select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()


# --- near duplicates


def test_fingerprint_and_components_equal_brute_force(spark, sf):
    import xxhash

    rows = {r["doc_id"]: r["text"] for r in _docs(spark, sf).filter("length(text) < 4000").collect()}
    got = {r["doc_id"]: r for r in S.near_duplicates(_docs(spark, sf).filter("length(text) < 4000")).collect()}
    prints = {}
    for k, text in rows.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = [x for x in w.replace("\n", " ").replace("\t", " ").split(" ") if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[k]["fingerprint"] == f"{prints[k]:016x}"
    label = {k: k for k in prints}
    for _ in range(20):
        for a in prints:
            label[a] = min(label[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {k: r["component_id"] for k, r in got.items()} == label


@pytest.mark.parametrize("tile,visitors", [(8, 3), (2048, 32)])
def test_tiles_lose_no_link(spark, tile, visitors):
    r = np.random.default_rng(4)
    base = r.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    fps = {int(x) for x in base}
    for x in base.tolist():
        for _ in range(6):
            y = x & ((1 << 64) - 1)
            for b in r.integers(0, 64, 3):
                y ^= 1 << int(b)
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps = sorted(fps)
    rows = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, id long")
    from chatloom.operators.graph import connected_components

    got = {x["node"]: x["component"] for x in connected_components(S.near_links(rows, tile=tile, visitors=visitors), "a", "b").collect()}
    near = [[j for j in range(len(fps)) if ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count() <= 4] for i in range(len(fps))]
    label = list(range(len(fps)))
    for _ in range(30):
        label = [min(label[j] for j in near[i]) for i in range(len(fps))]
    assert {k: got.get(k, k) for k in range(len(fps))} == dict(enumerate(label))


def test_edited_copies_leave_the_near_duplicate_stage(spark):
    r = random.Random(8)
    rows, words = [], {}
    for k in range(30):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(5, 400))]
        for j, edits in enumerate((0, 1, 2, 4, 8, 12)):
            own = list(base)
            for at in r.sample(range(len(own)), min(edits, len(own))):
                own[at] = f"x{r.randrange(5000)}"
            words[10 * k + j] = own
    words |= {1000 + k: ["the", "same", "line", "in", "every", "text", "of", "these", *(f"y{k}z{j}" for j in range(3 * k))] for k in range(60)}
    rows = [(k, " ".join(w)) for k, w in words.items()] + [(None, "a b"), (None, "a b"), (0, " ".join(words[0])), (2000, " ".join(words[0]).upper())]
    sets = {k: {tuple(x.lower() for x in w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    near = {a: [b for b in sets if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] for a in sets}
    label = {k: k for k in sets}
    for _ in range(8):
        label = {a: min(label[b] for b in near[a]) for a in sets}
    assert 90 < len(set(label.values())) < len(label) - 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [x["doc_id"] for x in K.near_dedup(spark, docs, "").collect()]
    assert got.count(None) == 2 and sorted(x for x in got if x is not None) == sorted(set(label.values()))


def test_pairs_that_meet_are_the_same_whatever_is_common(spark, sf):
    docs = _docs(spark, sf)
    want = {r["doc_id"]: r["component_id"] for r in N.near_copies(docs).collect()}
    was, N.COMMON = N.COMMON, 1
    try:
        assert {r["doc_id"]: r["component_id"] for r in N.near_copies(docs).collect()} == want
    finally:
        N.COMMON = was


# --- decontamination


def _plain_tiles(p, d, least):
    """Greedy string tiling by comparing everywhere."""
    fp, fd, out = [True] * len(p), [True] * len(d), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(d)):
                k = 0
                while i + k < len(p) and j + k < len(d) and fp[i + k] and fd[j + k] and p[i + k] == d[j + k] and d[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        for x in range(k):
            fp[i + x] = fd[j + x] = False
        out += k


def test_tiling_covers_as_much_as_the_plain_form():
    r = random.Random(7)
    for _ in range(60):
        p = [r.randrange(1, 9) for _ in range(r.randrange(5, 30))]
        cut = r.randrange(1, len(p))
        d = [*p[cut:], 0, *[r.randrange(0, 9) for _ in range(10)], *p[:cut]]
        got = D.greedy_tiles(p, d, 3, 8)
        assert all(p[i : i + n] == d[j : j + n] and n >= 3 for i, j, n in got)
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got) == len({x for _, j, n in got for x in range(j, j + n)})
        assert abs(sum(n for *_, n in got) - _plain_tiles(p, d, 3)) <= 3  # ties may be cut differently


def test_reordered_and_changed_passages_are_caught(spark, sf):
    item = [f"t{k}" for k in range(40)]
    texts = ["x " * 50 + " ".join(item), " ".join(item[20:]) + " filler words here " + " ".join(item[:20]), " ".join(w if k % 9 else "changed" for k, w in enumerate(item)), " ".join(item[:12]) + " other", " ".join(reversed(item))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item).upper())], "item_id long, text string")
    assert {r["doc_id"] for r in D.contaminated_pairs(docs, bench).collect()} == {0, 1, 2}
    assert {r["doc_id"] for r in D.without_contaminated(docs, bench).collect()} == {3, 4}
    plain = {(d["doc_id"], b["item_id"]) for d in _docs(spark, sf).collect() for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if b["text"] in d["text"]}
    assert plain and plain <= {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontamination"](spark, sf).collect()}


def test_pairs_equal_tiling_of_everything(spark, sf):
    docs, items = _docs(spark, sf).filter("length(text) < 6000"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["item_words"]) for r in D.contaminated_pairs(docs, items).collect()}
    want, bench = {}, [(b["item_id"], D.words(b["text"] or "")) for b in items.collect()]
    for d in docs.collect():
        own = D.words(d["text"] or "")
        grams = {tuple(own[i : i + D.LEAST]) for i in range(len(own))}
        for item_id, words in bench:
            if not any(tuple(words[i : i + D.LEAST]) in grams for i in range(len(words))):
                continue  # no tile can be
            number = {w: k + 1 for k, w in enumerate(dict.fromkeys(words))}
            covered = _plain_tiles([number[w] for w in words], [number.get(w, 0) for w in own], min(D.LEAST, len(words)))
            if covered >= D.COVERAGE * len(words):
                want[d["doc_id"], item_id] = (covered, len(words))
    assert len(want) >= 3 and got == want


def test_items_with_a_common_beginning_are_not_tiled(spark):
    r = random.Random(5)
    opening = "answer the following question about the text below"
    rows = [(k, f"{opening} " + " ".join(f"q{r.randrange(9000)}" for _ in range(30))) for k in range(3000)]
    text = " ".join([opening, *(f"t{r.randrange(5000)}" for _ in range(2000)), rows[7][1]])
    index = D.Items(rows)
    began = time.process_time()
    found = [(d, i) for d, i, _ in index.match([text], D.COVERAGE)]
    assert found == [(0, 7)] and time.process_time() - began < 1
    assert len(list(index.match([text]))) == 3000
    texts = [text, "", "nothing of it", rows[9][1], f"{rows[3][1]} and {rows[4][1]}", opening]
    want = [(d, i) for d, i, _ in index.match(texts, D.COVERAGE)]
    assert want == [(0, 7), (3, 9), (4, 3), (4, 4)]
    was, D.HELD = D.HELD, 1
    try:
        assert [(d, i) for d, i, _ in index.match(texts, D.COVERAGE)] == want
    finally:
        D.HELD = was


# --- language model


def _toy(spark, n=60):
    words = ["a", "b", "the", "of", "x", "y", "z"]
    rows = [(k, " ".join(random.Random(k).choices([*words, f"rare{k}", f"rare{k % 5}"], k=40))) for k in range(n)]
    return spark.createDataFrame([*rows, (3, rows[3][1]), (None, "a b"), (None, "a b"), (7000, "all unknown words"), (7001, None)], "doc_id long, text string")


def _chances(vocabulary, shared):
    """(word, restaurant) -> probability, straight from the rows; None is a word not known."""
    rows, c = {bytes(r["word"]): r for r in vocabulary.collect()}, shared.contexts

    def chance(word, ctx):
        r = rows.get(word)
        share = dict(zip(r["ctx"], r["share"], strict=True)) if r else {}
        if c.is_pair[ctx]:
            return share.get(ctx, 0) + shared.back[ctx] * chance(word, int(c.parent[ctx]))
        return share.get(ctx, 0) + shared.back[ctx] * (r["p"] * shared.scale if r else shared.even)

    return rows, chance


def test_probabilities_of_each_context_sum_to_one(spark):
    vocabulary, shared = H.learn(_toy(spark, 1200), F.lit(True), share=30, paired=3)
    rows, chance = _chances(vocabulary, shared)
    assert shared.contexts.paired == 3 and shared.contexts.n > 5
    for ctx in np.nonzero(shared.customers)[0]:
        known = sum(chance(w, int(ctx)) for w in rows)
        assert abs(known + chance(None, int(ctx)) - 1) < 1e-6
    assert len(rows) == shared.v and sum(r["c"] for r in rows.values()) == shared.n


@pytest.mark.parametrize("frequent,entries,dense", [(1 << 16, 1 << 22, 1 << 11), (6, 1 << 22, 2), (6, 60, 3), (0, 0, 0)])
def test_scores_equal_a_plain_reading_of_the_vocabulary(spark, frequent, entries, dense):
    docs = _toy(spark)
    vocabulary, shared = H.learn(docs.filter("doc_id < 60"), F.lit(True), share=30, paired=3)
    rows, chance = _chances(vocabulary, shared)
    number = {w: k for k, w in enumerate(shared.contexts.words)}
    n, want = shared.contexts.n, []
    for r in docs.collect():
        total, seen, tokens = 0.0, [], H.tokens(r["text"] or "")
        for w in tokens:
            two = [n, *seen][-1], [n, n, *seen][-2]
            ctx = n + 1 + two[1] * 3 + two[0] if max(two) < 3 else two[0]
            total += np.log10(chance(w, ctx))
            seen += [number[w]] if w in number else []
        want.append((r["doc_id"] or -1, len(tokens), sum(w in rows for w in tokens), total))
    got = [(r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["score"]) for r in H.score(docs, vocabulary, shared, frequent, entries, dense).collect()]
    for a, b in zip(sorted(want), sorted(got), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4 * max(1, -a[3])


def test_the_cut_of_files_changes_no_score(spark, sf):
    docs = _docs(spark, sf)
    scores = []
    for parts in (1, 7):
        own = docs.repartition(parts)
        vocabulary, shared = H.learn(own, F.lit(True))
        scores.append((shared.contexts.words, {r["doc_id"]: r["score"] for r in H.score(own, vocabulary, shared).collect()}))
    assert scores[0][0] == scores[1][0] and len(scores[0][0]) > 50
    assert all(abs(scores[1][1][k] - v) < 1e-5 * max(1, -v) for k, v in scores[0][1].items())


def test_context_words_are_exactly_those_with_the_share(spark, sf):
    texts = [r["text"] or "" for r in _docs(spark, sf).collect()]
    count = Counter(w for x in texts for w in H.tokens(x))
    want = {w for w, n in count.items() if w and n * 500 >= count.total()}
    for parts in (1, 9):
        assert set(H.context_words(_docs(spark, sf).select("text").repartition(parts), 500)) == want


def test_seats_follow_the_exact_posterior():
    d, opening = 0.4, 0.7
    draws = lambda n: H.Draws(np.arange(n, dtype=np.uint64))
    two = H.seat(np.full(40_000, 2), np.full(40_000, opening), d, draws(40_000))
    assert abs((two == 2).mean() - opening / (1 - d + opening)) < 0.01
    # Three customers: weight of 1, 2 and 3 tables.
    w = np.array([(1 - d) * (2 - d), 3 * (1 - d) * opening, opening**2])
    three = H.seat(np.full(40_000, 3), np.full(40_000, opening), d, draws(40_000))
    assert np.abs(np.bincount(three, minlength=4)[1:] / 40_000 - w / w.sum()).max() < 0.03
    # A block of twelve customers against seating them one by one.
    rng, plain = np.random.default_rng(0), np.ones(20_000)
    for seated in range(1, 12):
        plain += rng.random(20_000) < opening / (seated - d * plain + opening)
    twelve = H.seat(np.full(20_000, 12), np.full(20_000, opening), d, draws(20_000))
    assert abs(twelve.mean() - plain.mean()) < 0.05 and abs(twelve.std() - plain.std()) < 0.05
    many = H.seat(np.array([10, 1000, 10**6]), np.array([0.0, 0.5, 5.0]), d, draws(3))
    assert many[0] == 1 and 1 <= many[1] <= 1000 and many[2] > many[1]


def test_keyed_binomials_have_the_right_moments():
    n = 50_000
    for trials, p in ((1, 0.3), (7, 0.9), (40, 0.02), (200, 0.6), (5000, 0.5)):
        got = H.Draws(np.arange(n, dtype=np.uint64), trials).binomial(np.arange(n), np.full(n, trials), np.full(n, p))
        sd = np.sqrt(trials * p * (1 - p))
        assert abs(got.mean() - trials * p) < 5 * sd / np.sqrt(n) + 1e-9 and abs(got.std() / sd - 1) < 0.03 and got.min() >= 0 and got.max() <= trials


def test_base_scores_and_better_held_out_scores(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in _docs(spark, sf).collect()}
    count = Counter(w for k, x in docs.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in H.tokens(x))
    n, v = sum(count.values()), len(count)
    rows = QUERIES["op6_language_model"](spark, sf).collect()
    for r in rows:
        own = H.tokens(docs[r["doc_id"]])
        assert r["train_tokens"] == n and r["n_tokens"] == len(own) and r["n_known"] == sum(count[w] > 0 for w in own)
        assert abs(r["base_score"] - sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-6 * len(own)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# --- classifiers


def test_label_model_learns_accuracies_and_correlation():
    r = np.random.default_rng(2)
    y = r.random(20_000) < 0.2
    vote = lambda hit, miss: np.where(y, r.random(len(y)) < hit, r.random(len(y)) < miss) + 1
    a, b, c = vote(0.9, 0.05), vote(0.8, 0.1), vote(0.7, 0.2)
    rows, at, counts = np.unique(np.column_stack((a, b, c, c)), axis=0, return_inverse=True, return_counts=True)  # the last two are one voter twice
    known = np.zeros((len(rows), 2))
    np.add.at(known, (at[:400], y[:400].astype(int)), 1)
    model = X.LabelModel(rows, counts.astype(float), known)
    assert model.parent[3] == 2 or model.parent[2] == 3
    post = model.posterior(np.column_stack((a, b, c, c)))
    assert ((post > 0.5) == y).mean() > 0.93 and abs(model.prior[1] - 0.2) < 0.05


def test_toxicity_equals_a_plain_version(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(X.FOLDS)).cast("int").alias("fold")).collect()
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    teach = {r["doc_id"]: r for r in docs if r["doc_id"] in y and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    lexicons = {}
    for kind in "wp":
        for fold in range(X.FOLDS):
            n = Counter()
            for k, r in teach.items():
                words = {w for w in X._WORD.findall((r["text"] or "").lower())} if r["fold"] == fold else set()
                n.update((e, y[k]) for e in (words if kind == "w" else {w[:m] for w in words for m in X.PREFIXES if len(w) > m}))
            rated = [(-round(n[e, 1] / (n[e, 1] + n[e, 0] + 1) * np.log1p(n[e, 1]), 9), e) for e in {e for e, _ in n} if n[e, 1] >= X.LEAST_TOXIC and n[e, 1] - n[e, 1] ** 0.5 >= X.LEAST_RATIO * (n[e, 1] + n[e, 0])]
            lexicons[kind, fold] = [e for _, e in sorted(rated)[: X.ENTRIES]]
    got = X.toxicity(_docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), ~X.remainder_is(F.col("doc_id"), 5, 0)).collect()
    lexicon = X.Lexicon(lexicons)
    assert lexicon.size > 5 and len(got) == len(docs)
    text, own = {r["doc_id"]: r["text"] or "" for r in docs}, {}
    for r in got:
        words = X._WORD.findall(text[r["doc_id"]].lower())
        hits, votes = lexicon.read(text[r["doc_id"]])
        assert r["votes"] == votes and dict(zip(r["idx"], r["cnt"], strict=True)) == hits
        for e, at in lexicon.at["w"].items():
            assert hits.get(at, 0) == words.count(e)
        for e, at in lexicon.at["p"].items():
            assert hits.get(at, 0) == sum(len(w) > len(e) and w.startswith(e) for w in words)
        for k in range(X.FOLDS):  # a voter sees its own lexicon alone
            assert (votes[k] == "2") == any(w in lexicons["w", k] for w in words)
        own[r["doc_id"]] = votes
    count, known = Counter(own.values()), Counter((own[k], y[k]) for k in teach)
    names = sorted(count)
    model = X.LabelModel(X._digits(names), np.array([count[p] for p in names], float), np.array([[known[p, v] for v in (0, 1)] for p in names], float))
    post = dict(zip(names, model.posterior(X._digits(names)), strict=True))
    assert all(abs(r["label_posterior"] - post[r["votes"]]) < 1e-6 for r in got)
    rows = sorted(got, key=lambda r: (not r["idx"], r["doc_id"]))
    table = X._digits([r["votes"] for r in rows])
    x = X.features([r["idx"] for r in rows], [r["cnt"] for r in rows], table, lexicon.size)
    w, b = X.fit_linear(x, model.posterior(table))
    plain = 1 / (1 + np.exp(-(x.astype(float) @ w + b)))
    assert np.abs(plain - np.array([r["score"] for r in rows])).max() < 0.02  # rows in another order add up in another order


def test_attention_gradients_and_learning():
    r = np.random.default_rng(0)
    x, counts = r.normal(size=(60, Q.FEATURES)), np.array([1, 5, 4] * 6)
    y = np.array([0.0, 1, 1] * 6)
    x[np.cumsum(counts)[y == 1] - 1, 0] += 6  # one passage decides
    model = Q.AttentionModel().fit(x, counts, y)
    begin, bag = np.concatenate(([0], np.cumsum(counts)[:-1])), np.repeat(np.arange(len(counts)), counts)
    f = model._forward((x - model.mean) / model.scale, begin, bag)
    assert ((f["y"] > 0.5) == (y == 1)).all()
    assert np.allclose(np.add.reduceat(f["a"], begin), 1)
    fresh = Q.AttentionModel(3)
    loss = lambda: -np.mean(np.log(np.where(y == 1, z := fresh._forward(x, begin, bag)["y"], 1 - z)))
    grad = fresh._gradient(fresh._forward(x, begin, bag), x, begin, bag, y)
    for name, d in grad.items():
        for at in ([0] * d.ndim, [n - 1 for n in d.shape]):
            at = tuple(at)
            was = fresh.p[name][at]
            fresh.p[name][at] = was + 1e-5
            up = loss()
            fresh.p[name][at] = was - 1e-5
            assert abs((up - loss()) / 2e-5 - d[at]) < 1e-6 + 1e-4 * abs(d[at]), name
            fresh.p[name][at] = was


def test_quality_equals_a_plain_version(spark, sf):
    docs, labels = _docs(spark, sf), {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    taught = sorted(k for k in labels if k in text and zlib.crc32(str(k).encode()) % 5)
    x, counts = Q.passages([text[k] for k in taught])
    model = Q.AttentionModel().fit(x.astype(float), counts, np.array([labels[k] for k in taught], float))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op8_quality_classifier"](spark, sf).collect()}
    assert max(counts) < Q.TAUGHT_PASSAGES and got.keys() == text.keys()
    for k, score in got.items():
        own, n = Q.passages([text[k]])
        h = np.tanh((own - model.mean) / model.scale @ model.p["W"] + model.p["b"])
        logit = (np.tanh(h @ model.p["V"]) / (1 + np.exp(-h @ model.p["U"]))) @ model.p["w"]
        a = np.exp(logit - logit.max())
        assert abs(score - 1 / (1 + np.exp(-(a @ h / a.sum() @ model.p["c"] + model.p["e"][0])))) < 0.02 and n[0] == len(own)


def _auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = sum(y)
    return (rank[np.array(y) == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("name,label,least", [("op7_toxicity", "toxic", 0.85), ("op8_quality_classifier", "quality", 0.9)])
def test_held_out_ranking(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert _auc(got[label].tolist(), got["score"].to_numpy()) > least


# --- token counts and pipeline


def test_commits_are_idempotent_and_signed(spark, tmp_path):
    kind = "struct<source:string,lang:string,version:string,tokens:bigint>"
    rows = spark.createDataFrame([(("s", "en", "v1", 10), None), (("s", "en", "v1", 5), None)], f"new {kind}, old {kind}")
    store = C.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    assert store.commit("a", rows) and not store.commit("a", rows)
    (tmp_path / "r" / "cut-off").mkdir()  # without a success marker
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v1", 2, 15)]
    store.commit("b", spark.createDataFrame([(("s", "en", "v2", 7), ("s", "en", "v1", 10)), (None, ("s", "en", "v1", 5))], f"new {kind}, old {kind}"))
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v2", 1, 7)]


def _jaccard_groups(texts):
    """doc_id -> smallest doc_id of its group, by comparing all shingle sets."""
    words = {k: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in x.split()] for k, x in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    label, ids = {k: k for k in sets}, sorted(sets)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(len(ids)):
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_pipeline_stages_against_plain_filters(spark, sf):
    docs = _docs(spark, sf)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    kept = K.language(spark, docs, sf)
    found = L.identify(docs, L.learn_profiles(docs, L.teaching_rows())).collect()
    assert kept.columns == docs.columns and ids(kept) == sorted(r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= K.LEAST_LANGUAGE_SCORE)
    good = K.quality(spark, kept, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rated = Q.scored(kept, Q.learn(kept, labels, "quality", Q.teaching_rows())).collect()
    assert good.columns == docs.columns and ids(good) == sorted(r["doc_id"] for r in rated if r["score"] >= 0.3)
    once = K.near_dedup(spark, good, sf)
    groups = _jaccard_groups({r["doc_id"]: r["text"] for r in good.collect()})
    assert once.columns == docs.columns and ids(once) == sorted(set(groups.values()))
    clean = K.decontaminate(spark, once, sf)
    flagged = {r["doc_id"] for r in D.contaminated_pairs(once, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(ids(clean)) == set(ids(once)) - flagged and clean.columns == docs.columns
    pieces = K.pack(spark, clean, sf).collect()
    whole = Counter()
    for r in pieces:
        whole[r["doc_id"]] += r["length"]
    assert sorted(whole) == ids(clean) and all(whole[r["doc_id"]] == r["doc_tokens"] for r in pieces)
    good_labels = labels.filter("quality = 1").join(kept, "doc_id", "left_semi")
    assert good_labels.join(good, "doc_id", "left_semi").count() >= 0.97 * good_labels.count()
    ran = corpus_pipeline.run(spark, sf)
    assert Counter((r["doc_id"], r["length"]) for r in ran.collect()).keys() <= {(r["doc_id"], n) for r in pieces for n in range(1, 2049)}


def test_a_group_of_near_copies_meets_nobody(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(3000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        own = list(base)
        own[r.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = {}
    real = N.meeting_pairs
    N.meeting_pairs = lambda firsts: seen.setdefault("pairs", real(firsts))
    try:
        assert {x["component_id"] for x in N.near_copies(docs).collect()} == {0}
    finally:
        N.meeting_pairs = real
    assert seen["pairs"].count() < 4 * 400  # of 79,800


def test_meetings_equal_a_comparison_of_all():
    r = np.random.default_rng(5)
    k = 900
    rows = np.stack([r.choice([1, 2, 3, 4], k, p=[0.6, 0.38, 0.01, 0.01]), r.integers(5, 60, k), r.integers(0, 4, k), np.zeros(k, np.int64)])
    rows[3] = r.integers(0, 1 + rows[1] // 5)
    shingle, n, part, pos = rows = rows[:, np.lexsort((rows[1], rows[0]))]
    want = {
        (i, j)
        for i in range(k)
        for j in range(i + 1, k)
        if shingle[i] == shingle[j] and part[i] != part[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and 9 * min(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j])
    }
    got = [(min(x), max(x)) for i, j in N._meetings(*rows) for x in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_sketches_never_rule_out_a_similar_pair(spark):
    r = np.random.default_rng(6)
    sets, pairs = [], []
    for k in range(0, 400, 2):
        own = np.unique(r.integers(-(1 << 62), 1 << 62, int(r.integers(1, 6000))))
        other = np.unique(np.concatenate([own[int(len(own) * r.uniform(0, 0.3)) :], r.integers(-(1 << 62), 1 << 62, int(len(own) * r.uniform(0, 0.1)))]))
        sets += [own, other]
        pairs += [(k, k + 1), (k, (k + 3) % 400)]
    rows = spark.createDataFrame([(k, len(x), N.sketch(x)) for k, x in enumerate(sets)], "id long, n long, bits binary")
    kept = {tuple(x) for x in N.could_be_similar(spark.createDataFrame(pairs, "a long, b long"), rows).collect()}
    true = {(a, b) for a, b in pairs if len(sets[a]) and len(sets[b]) and N.similar(sets[a], sets[b])}
    assert len(true) > 50 and true <= kept and len(kept) < len(pairs)
