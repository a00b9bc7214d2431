"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded (measured features,
then a learned tanh layer); gated attention, learned from document labels alone, weighs
the passages; a logistic unit scores the weighted sum. Training is full-batch Adam on a
bounded sample of labelled documents; scoring reads every text whole.

Defined cases: a null or blank text is one passage of zeros; null labels teach nothing; an id labelled
twice has its larger label; of rows with one id the one with the smallest text teaches;
without both labels every score is the share of label 1 (0.5 with none); a score at the threshold is
predicted 1; repeated rows give repeated results; a null doc_id is scored; an empty table gives no
rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import bounded_sample, documents, per_slice, remainder_is

PASSAGE = 64
#: Training uses at most this many labelled documents, those with the smallest hash of their id.
TEACHERS = 6000
#: Of a longer teaching text so many passages are learned from, evenly spaced. Scoring takes all.
TAUGHT_PASSAGES = 128
HIDDEN, ATTENTION, ROUNDS, RATE, DECAY = 24, 12, 250, 0.02, 1e-4
PREDICT_AT = 0.3

# Byte classes that passages are measured by: lower, upper, digit, beyond ASCII, then single marks.
_MARKS = b".,!?;:|#*$%&<>/-_'\"()=@"


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1], table[128:] = 1, 2, 3, 4
    for k, c in enumerate(_MARKS):
        table[c] = 5 + k
    return table


_CLASS, _N = _classes(), 5 + len(_MARKS)
FEATURES = _N + 5


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32) and how many each text has."""
    blank = np.zeros((1, FEATURES), np.float32)
    feats, counts = [], []
    for text in texts:
        lines, seen, repeated, words = text.encode("utf-8", "surrogatepass").split(b"\n"), set(), [], []
        for line in lines:
            own = line.split()
            words += own
            repeated += [line in seen] * len(own)
            seen.add(line)
        if not words:
            feats.append(blank)
            counts.append(1)
            continue
        size = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.arange(0, len(words), PASSAGE)
        flat = _CLASS[np.frombuffer(b"".join(words), np.uint8)]
        chars = np.add.reduceat(size, starts)
        passage = np.repeat(np.arange(len(starts)), chars)
        shares = np.bincount(passage * _N + flat, minlength=len(starts) * _N).reshape(-1, _N) / chars[:, None]
        n = np.diff(np.append(starts, len(words)))
        unique = np.array([len(set(words[a : a + PASSAGE])) for a in starts]) / n
        twice = np.add.reduceat(np.array(repeated, np.float64), starts) / n
        rest = np.column_stack((chars / n / 10, unique, twice, np.log1p(n) / 5, np.full(len(starts), np.log1p(len(words)) / 10)))
        feats.append(np.hstack((shares, rest)).astype(np.float32))
        counts.append(len(starts))
    return np.concatenate(feats) if feats else np.zeros((0, FEATURES), np.float32), np.array(counts, np.int64)


class AttentionModel:
    """score = sigmoid(c . sum_k a_k h_k + e), a = softmax(w . (tanh(V h) * sigmoid(U h))), h = tanh(W x + b)."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        init = lambda *shape: r.normal(0, shape[0] ** -0.5, shape)
        self.p = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "e": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None

    def _forward(self, x: np.ndarray, begin: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        logit = (t * g) @ p["w"]
        a = np.exp(logit - np.maximum.reduceat(logit, begin)[bag])
        a /= np.add.reduceat(a, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["e"], -30, 30)))}

    def _gradient(self, f: dict, x: np.ndarray, begin: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean log loss by each parameter."""
        p = self.p
        dy = (f["y"] - y) / len(y)
        dz = dy[:, None] * p["c"]
        da = (f["h"] * dz[bag]).sum(1)
        dl = f["a"] * (da - np.add.reduceat(f["a"] * da, begin)[bag])
        dt, dg = dl[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), dl[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ dl, "c": f["z"].T @ dy, "e": np.array([dy.sum()])}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> AttentionModel:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        begin, bag, p = np.concatenate(([0], np.cumsum(counts)[:-1])), np.repeat(np.arange(len(counts)), counts), self.p
        m, v = ({k: np.zeros_like(u) for k, u in p.items()} for _ in range(2))
        for k in range(1, rounds + 1):
            grad = self._gradient(self._forward(x, begin, bag), x, begin, bag, y)
            for name, d in grad.items():
                d = d + DECAY * p[name]
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.999 * v[name] + 0.001 * d * d
                p[name] -= RATE * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        x, counts = passages(texts)
        begin, bag = np.concatenate(([0], np.cumsum(counts)[:-1])), np.repeat(np.arange(len(counts)), counts)
        return self._forward((x - self.mean) / self.scale, begin, bag)["y"]


def _features(rows: pa.RecordBatch, texts: list[str]) -> dict:
    x, counts = passages(texts)
    spaced = lambda n: np.unique(np.linspace(0, n - 1, min(n, TAUGHT_PASSAGES)).astype(int))
    return {"y": rows.column(rows.schema.get_field_index("y")), "x": [x[b - n : b][spaced(n)].ravel() for b, n in zip(np.cumsum(counts), counts, strict=True)]}


def learn(docs: DataFrame, labels: DataFrame, label: str, teaches: Column, teachers: int = TEACHERS, text: str = "text") -> AttentionModel:
    """Fit on labelled documents for which `teaches` (on doc_id) holds."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & teaches).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = bounded_sample(rows, "doc_id", teachers)
    schema = pa.schema([("y", pa.float64()), ("x", pa.list_(pa.float32()))])
    taught = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    bags = taught.select("text", "y").mapInArrow(per_slice(_features, schema), "y double, x array<float>")
    got = bags.toArrow()  # TEACHERS * TAUGHT_PASSAGES passages at most
    x = np.asarray(got.column("x").combine_chunks().flatten(), np.float64).reshape(-1, FEATURES) if got.num_rows else np.zeros((0, FEATURES))
    counts = np.array([len(v) // FEATURES for v in got.column("x")], np.int64)
    y = np.asarray(got.column("y"), np.float64)
    return AttentionModel().fit(x, counts, y)


def scored(docs: DataFrame, model: AttentionModel, text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    run = per_slice(lambda rows, texts: {"doc_id": rows.column(0), "score": sent.value.score(texts)}, schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def teaching_rows() -> Column:
    return ~remainder_is(F.col("doc_id"), 5, 0)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scored(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", teaching_rows()))
    return found.select("doc_id", remainder_is(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
