"""Toxicity by weak supervision.

Many voters vote toxic, clean or abstain on every document. Lexicon voters hold words, or
beginnings of words, that mark toxic labels in one of FOLDS disjoint parts of the labelled
documents, and see no other lexicon: each says toxic at a hit of its own, clean without one,
and abstains on a text of fewer than LEAST_WORDS words or with an empty lexicon. Pattern
voters (insults, an insulted reader, hits that repeat or lie thick, shouting, exclamation,
words said three times over, masked letters) say toxic or abstain. A generative label model, fitted by
expectation-maximisation, estimates each voter's accuracies and, by a dependency tree
within each class, the correlations between voters. Its posterior labels train a linear
classifier on the hits of the lexicons, which scores all documents.

Texts are read once by Python workers; the scores are sums of looked-up weights, which the
JVM takes from what was read. At most 3^6 * 2^8 vote patterns reach the driver.

Defined cases: a null or empty text has no hit and gets the score of such a text, however
long a text is it is read whole; null labels teach nothing; an id labelled twice has its
larger label; of rows with one id the one with the smallest text teaches; with no toxic label, the fixed patterns
alone vote; entries of equal worth go by name; repeated rows give repeated results; a null
doc_id is scored; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.common import bounded_sample, documents, per_slice, remainder_is
from chatloom.session import staged

#: At most this many labelled documents teach (smallest hash of the id), so many entries a
#: lexicon, and so many posterior-labelled documents train the classifier.
TEACHERS, ENTRIES, TRAIN = 20_000, 200, 20_000
PREFIXES = (4, 5, 6, 7, 8)
FOLDS = 3
LEAST_TOXIC, LEAST_RATIO, LEAST_WORDS = 3, 0.4, 5
PREDICT_AT = 0.5
_WORD = re.compile(r"[^\W\d_]+")
# Insults and ways to address a reader with one.
INSULT = re.compile(r"\b(?:idiots?|morons?|stupid|losers?|scum|trash|pathetic|worthless|disgusting|clowns?)\b")
ADDRESS = re.compile(r"\byou(?:'re| are)? (?:a |an |such |so )?(?:idiot|moron|stupid|loser|pathetic|worthless|disgusting|clown)")
THRICE = re.compile(r"\b(\w{3,}) \1 \1\b")
MASKED = re.compile(r"\b[a-z]+[*@#$]+[a-z]+\b")
SHOUT = re.compile(r"\b[A-Z]{3,}\b")
KINDS = ("w", "p")
LEXICONS = tuple(f"{'words' if kind == 'w' else 'starts'}{fold}" for kind in KINDS for fold in range(FOLDS))
PATTERNS = ("insult", "address", "twice", "thick", "shout", "exclaim", "thrice", "masked")
VOTERS = LEXICONS + PATTERNS
ABSTAIN, CLEAN, TOXIC = 0, 1, 2


def entries_of(words: Counter) -> set[tuple[str, str]]:
    """Words as ('w', word) and their beginnings as ('p', beginning)."""
    found = {("w", w) for w in words}
    for n in PREFIXES:
        found |= {("p", w[:n]) for w in words if len(w) > n}
    return found


_COUNTS = pa.schema([("fold", pa.int32()), ("kind", pa.string()), ("entry", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _count_entries(rows: pa.RecordBatch, texts: list[str]) -> dict:
    place = rows.schema.get_field_index
    n: dict[tuple, list[int]] = {}
    for text, y, fold in zip(texts, rows.column(place("y")).to_pylist(), rows.column(place("fold")).to_pylist(), strict=True):
        for kind, entry in entries_of(Counter(_WORD.findall(text.lower()))):
            n.setdefault((fold, kind, entry), [0, 0])[0 if y else 1] += 1
    return {"fold": [k[0] for k in n], "kind": [k[1] for k in n], "entry": [k[2] for k in n], "toxic": [v[0] for v in n.values()], "clean": [v[1] for v in n.values()]}


def mine(teach: DataFrame, most: int = ENTRIES) -> dict[tuple[str, int], list[str]]:
    """(kind, fold) -> entries, best first. teach: (text, y, fold), bounded by the teachers."""
    counts = teach.mapInArrow(per_slice(_count_entries, _COUNTS, most_chars=4_000_000), "fold int, kind string, entry string, toxic long, clean long")
    counts = counts.groupBy("fold", "kind", "entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    # One standard deviation less than the toxic documents counted must still make up the ratio.
    counts = counts.filter((F.col("t") >= LEAST_TOXIC) & (F.col("t") - F.sqrt("t") >= LEAST_RATIO * (F.col("t") + F.col("c"))))
    worth = F.round(F.col("t") / (F.col("t") + F.col("c") + 1) * F.log1p("t"), 9)
    k = F.row_number().over(Window.partitionBy("fold", "kind").orderBy(F.desc("worth"), "entry"))
    best = counts.withColumn("worth", worth).withColumn("k", k).filter(F.col("k") <= most).select("kind", "fold", "entry", "k")
    found: dict[tuple[str, int], list[str]] = {(kind, fold): [] for kind in KINDS for fold in range(FOLDS)}
    for r in sorted(best.collect(), key=lambda r: r["k"]):  # ENTRIES rows a lexicon at most
        found[r["kind"], r["fold"]].append(r["entry"])
    return found


class Lexicon:
    """All entries by number, and which lexicons hold each."""

    def __init__(self, mined: dict[tuple[str, int], list[str]]):
        self.at: dict[str, dict[str, int]] = {}
        self.owners: list[set[int]] = []
        for kind in KINDS:
            own = self.at.setdefault(kind, {})
            for fold in range(FOLDS):
                for entry in mined.get((kind, fold), []):
                    if entry not in own:
                        own[entry] = len(self.owners)
                        self.owners.append(set())
                    self.owners[own[entry]].add(LEXICONS.index(f"{'words' if kind == 'w' else 'starts'}{fold}"))
        self.held = [any(k in o for o in self.owners) for k in range(len(LEXICONS))]
        self.lengths = sorted({len(w) for w in self.at["p"]})
        self.size = len(self.owners)

    def read(self, text: str) -> tuple[dict[int, int], str]:
        """Hits by entry, and the votes as a digit for each voter."""
        low = text.lower()
        found = _WORD.findall(low)
        words, starts = self.at["w"], self.at["p"]
        hits: dict[int, int] = {}
        marked = 0
        for w, n in Counter(found).items():
            own = [words[w]] if w in words else []
            own += [starts[w[:length]] for length in self.lengths if len(w) > length and w[:length] in starts]
            for k in own:
                hits[k] = hits.get(k, 0) + n
            marked += n * bool(own)
        hit: set[int] = set().union(*(self.owners[k] for k in hits))
        enough = len(found) >= LEAST_WORDS
        votes = [TOXIC if k in hit else CLEAN if enough and self.held[k] else ABSTAIN for k in range(len(LEXICONS))]
        loud = len(SHOUT.findall(text))
        says = (
            INSULT.search(low) is not None, ADDRESS.search(low) is not None, marked >= 2, marked >= 2 and marked >= 0.01 * len(found),
            loud >= 3 and loud >= 0.3 * len(found), "!!!" in text or text.count("!") > 0.1 * len(found) + 1, THRICE.search(low) is not None, MASKED.search(low) is not None,
        )
        return hits, "".join(map(str, votes)) + "".join(str(TOXIC if x else ABSTAIN) for x in says)


class LabelModel:
    """Two classes; within a class each voter depends on at most one other (a tree of voters)."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray):
        """patterns: votes; counts: documents with them; known: documents by label (0, 1) among the labelled."""
        self.m = m = patterns.shape[1]
        toxic, clean = (patterns == TOXIC).sum(1), (patterns == CLEAN).sum(1)
        # It begins from the labelled documents with a pattern, and from the votes where there are few.
        post = (known[:, 1] + 2 / (1 + np.exp(-(2.0 * toxic - clean - 1.0)))) / (known.sum(1) + 2)
        free = np.maximum(counts - known.sum(1), 0)
        self.parent = np.full(m, -1)
        for k in range(60):
            weight = np.stack((free * (1 - post) + known[:, 0], free * post + known[:, 1]))
            if k in (0, 3, 10, 25, 40):
                self.parent = self._tree(patterns, weight)
            self._estimate(patterns, weight)
            new = self.posterior(patterns)
            if k > 41 and np.abs(new - post).max() < 1e-6:
                break
            post = new

    def _pair(self, patterns: np.ndarray, weight: np.ndarray, a: int, b: int) -> np.ndarray:
        n = np.bincount(patterns[:, a] * 3 + patterns[:, b], weights=weight, minlength=9).reshape(3, 3) + 0.1
        return n / n.sum()

    def _tree(self, patterns: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The spanning tree of the largest conditional mutual information."""
        gain = np.zeros((self.m, self.m))
        for a in range(self.m):
            for b in range(a):
                for y in (0, 1):
                    p = self._pair(patterns, weight[y], a, b)
                    gain[a, b] += weight[y].sum() / max(weight.sum(), 1e-9) * (p * np.log(p / (p.sum(1)[:, None] * p.sum(0)))).sum()
                gain[b, a] = gain[a, b]
        parent, inside = np.full(self.m, -1), {0}
        while len(inside) < self.m:
            a, b = max(((a, b) for a in inside for b in range(self.m) if b not in inside), key=lambda x: (gain[x], -x[0], -x[1]))
            parent[b] = a
            inside.add(b)
        return parent

    def _estimate(self, patterns: np.ndarray, weight: np.ndarray) -> None:
        self.prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        self.table = []
        for a in range(self.m):
            own = []
            for y in (0, 1):
                above = patterns[:, self.parent[a]] if self.parent[a] >= 0 else np.zeros(len(patterns), np.int64)
                n = np.bincount(above * 3 + patterns[:, a], weights=weight[y], minlength=9).reshape(3, 3)
                n += 0.5 * (n.sum(0) + 0.1) / (n.sum() + 0.3)
                own.append(n / n.sum(1)[:, None])
            self.table.append(own)

    def ratios(self) -> list[np.ndarray]:
        """For each voter log P(vote | toxic) / P(vote | clean), by 3 * the vote of its parent (0 for the root) + its own."""
        return [np.log(own[1] / own[0]).ravel() for own in self.table]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = np.full(len(patterns), np.log(self.prior[1] / self.prior[0]))
        for a, ratio in enumerate(self.ratios()):
            above = patterns[:, self.parent[a]] if self.parent[a] >= 0 else np.zeros(len(patterns), np.int64)
            odds += ratio[above * 3 + patterns[:, a]]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam."""
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, rounds + 1):
        e = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -30, 30))) - y
        d = np.append(e.astype(x.dtype) @ x / len(y) + decay * w, e.mean())
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def features(idx: list, cnt: list, votes: np.ndarray, size: int) -> np.ndarray:
    """log1p of hits by entry, then of all hits, whether there is one, and whether each voter says toxic or says clean."""
    x = np.zeros((len(votes), size + 2 + 2 * len(VOTERS)), np.float32)
    for r, (i, c) in enumerate(zip(idx, cnt, strict=True)):
        if i:
            x[r, i] = np.log1p(c)
            x[r, size] = np.log1p(sum(c))
            x[r, size + 1] = 1
    x[:, size + 2 :] = np.hstack((votes == TOXIC, votes == CLEAN))
    return x


def _digits(patterns: list[str]) -> np.ndarray:
    return np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(-1, len(VOTERS))


def _numbers(values) -> Column:
    return F.lit([float(v) for v in values])


def _logistic(z: Column, most: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), z))))


def linear_score(w: np.ndarray, b: float, size: int) -> Column:
    """The classifier on (votes, idx, cnt)."""
    summed = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    own, z = _numbers(w[:size]), F.lit(float(b))
    if size:
        z = z + summed(F.zip_with("idx", "cnt", lambda i, c: F.get(own, i) * F.log1p(c)))
    total = F.aggregate("cnt", F.lit(0), lambda s, v: s + v)
    z = z + F.log1p(total) * float(w[size]) + (F.size("idx") > 0).cast("double") * float(w[size + 1])
    for k in range(len(VOTERS)):
        weights = _numbers((0, w[size + 2 + len(VOTERS) + k], w[size + 2 + k]))  # of abstain, clean, toxic
        z = z + F.get(weights, F.substring("votes", k + 1, 1).cast("int"))
    return _logistic(z, 30)


def pattern_posterior(model: LabelModel) -> Column:
    """The label model's posterior of (votes)."""
    vote = lambda k: F.substring("votes", k + 1, 1).cast("int")
    odds = F.lit(float(np.log(model.prior[1] / model.prior[0])))
    for a, ratio in enumerate(model.ratios()):
        above = vote(int(model.parent[a])) * 3 if model.parent[a] >= 0 else F.lit(0)
        odds = odds + F.get(_numbers(ratio), above + vote(a))
    return _logistic(odds, 50)


def toxicity(docs: DataFrame, labels: DataFrame, teaches: Column, label: str = "toxic", text: str = "text", teachers: int = TEACHERS, train: int = TRAIN) -> DataFrame:
    """(doc_id, score, label_posterior, votes, idx, cnt) of every row; votes has a digit a voter, idx and cnt the hits by entry."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & teaches).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = F.broadcast(bounded_sample(rows, "doc_id", teachers))
    teach = docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    lexicon = spark.sparkContext.broadcast(Lexicon(mine(teach.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(FOLDS)).cast("int")))))

    def read(rows: pa.RecordBatch, texts: list[str]) -> dict:
        out: dict = {"doc_id": rows.column(0), "votes": [], "idx": [], "cnt": []}
        for text in texts:
            hits, votes = lexicon.value.read(text)
            keys = sorted(hits)
            out["votes"].append(votes)
            out["idx"].append(keys)
            out["cnt"].append([hits[k] for k in keys])
        return out

    kind = "doc_id long, votes string, idx array<int>, cnt array<int>"
    schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.string()), ("idx", pa.list_(pa.int32())), ("cnt", pa.list_(pa.int32()))])
    seen = staged(docs.mapInArrow(per_slice(read, schema), kind))
    patterns = {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not patterns:
        return seen.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("label_posterior"), "votes", "idx", "cnt")
    known = {(r["votes"], r["y"]): r["n"] for r in seen.select("doc_id", "votes").join(chosen, "doc_id").groupBy("votes", "y").agg(F.count("*").alias("n")).collect()}
    names = sorted(patterns)
    model = LabelModel(_digits(names), np.array([patterns[p] for p in names], np.float64), np.array([[known.get((p, y), 0) for y in (0, 1)] for p in names], np.float64))
    # Documents without a hit are all alike to the classifier: a quarter of the sample shows them to it.
    some = lambda df, n: bounded_sample(df, "doc_id", n).toArrow()
    table = pa.concat_tables([some(seen.filter(F.size("idx") > 0), train * 3 // 4), some(seen.filter(F.size("idx") == 0), train // 4)])
    votes, size = _digits(table.column("votes").to_pylist()), lexicon.value.size
    w, b = fit_linear(features(table.column("idx").to_pylist(), table.column("cnt").to_pylist(), votes, size), model.posterior(votes))
    return seen.select("doc_id", linear_score(w, b, size).alias("score"), pattern_posterior(model).alias("label_posterior"), "votes", "idx", "cnt")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~remainder_is(F.col("doc_id"), 5, 0))
    return found.select("doc_id", remainder_is(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "label_posterior")
