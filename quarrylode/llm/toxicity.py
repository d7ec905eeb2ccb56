"""Toxic spans and document scores by a linear-chain conditional random field.

Documents are labelled, not tokens: in a toxic document of the training sample the tokens are
labelled toxic whose word or prefix is much more frequent in toxic documents than in others. The
field has two states, weights for words and prefixes, and transitions. Forward-backward marginals
give toxic spans; their sum and maximum, calibrated on the sample's documents, give the score.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylode.llm.common import table

WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7)
#: Labelled documents (of the smallest hashes) from which the model is fitted; features kept.
SAMPLE, FEATURES, LEAST_DOCS = 6000, 20000, 6
#: Log odds from which a feature marks a token of a toxic document as toxic.
MARKS = 2.5
SEGMENT, ROUNDS, RIDGE = 64, 60, 0.5
#: Background tokens after which a chain has forgotten what came before.
FORGOTTEN = 63
CACHE = 1 << 19


def features(word: str) -> list[str]:
    return ["=" + word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    steps: np.ndarray  # log potentials of the transitions, [from, to]
    scale: tuple[float, float, float]  # of the document score: 1, log(1 + sum), maximum
    cache: dict[str, float] = field(default_factory=dict)
    powers: np.ndarray | None = None

    def __post_init__(self) -> None:
        step = np.exp(self.steps + np.array([0.0, self.bias]))
        self.powers = np.empty((FORGOTTEN + 1, 2, 2))
        self.powers[0] = np.eye(2)
        for n in range(1, FORGOTTEN + 1):
            p = self.powers[n - 1] @ step
            self.powers[n] = p / p.sum()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def emissions(self, words: list[str]) -> list[float]:
        cache, weights = self.cache, self.weights
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for w in words:
            e = cache.get(w)
            if e is None:
                e = cache[w] = sum(weights.get(f, 0.0) for f in features(w.lower()))
            out.append(e)
        return out

    def marginals(self, n: int, at: list[int], emission: list[float]) -> list[float]:
        """P(toxic) of the tokens at the given places of n; all others have no feature.

        Runs of tokens without features are one matrix, a power of the background's step.
        """
        step = np.exp(self.steps + np.array([0.0, self.bias]))
        ahead, alpha, last = [], np.array([1.0, np.exp(self.bias)]), 0
        for k, e in zip(at, emission, strict=True):
            if k > last:
                alpha = alpha @ self.powers[min(k - last - 1, FORGOTTEN)] @ step
            alpha = alpha * (1.0, np.exp(min(e, 50.0)))
            alpha /= alpha.sum()
            ahead.append(alpha)
            last = k
        out, beta, after = [0.0] * len(at), np.ones(2), n - 1
        beta = self.powers[min(n - 1 - at[-1], FORGOTTEN)] @ beta if at else beta
        for i in range(len(at) - 1, -1, -1):
            if i + 1 < len(at):
                tail = beta * (1.0, np.exp(min(emission[i + 1], 50.0)))
                beta = self.powers[min(at[i + 1] - at[i] - 1, FORGOTTEN)] @ step @ tail
            beta /= beta.sum()
            both = ahead[i] * beta
            out[i] = float(both[1] / both.sum())
        return out

    def read(self, text: str | None) -> tuple[float, float, list[int], list[float]]:
        """(sum, maximum, places, marginals) of a text's tokens that have features."""
        emission = self.emissions(WORD.findall(text or ""))
        at = [i for i, e in enumerate(emission) if e]
        if not at:
            return 0.0, 0.0, [], []
        p = self.marginals(len(emission), at, [emission[i] for i in at])
        return sum(p), max(p), at, p

    def score(self, total: float, most: float) -> float:
        a, b, c = self.scale
        return float(1.0 / (1.0 + np.exp(-(a + b * np.log1p(total) + c * most))))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """Score and toxic spans (code points, end exclusive; runs of toxic tokens are one)."""
        total, most, at, p = self.read(text)
        toxic = [i for i, x in zip(at, p, strict=True) if x >= 0.5]
        spans: list[tuple[int, int]] = []
        if toxic:
            places, before = [m.span() for m in WORD.finditer(text)], -2
            for i in toxic:
                if i == before + 1:
                    spans[-1] = (spans[-1][0], places[i][1])
                else:
                    spans.append(places[i])
                before = i
        return self.score(total, most), spans


def _chain(emission: np.ndarray, steps: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals P(toxic) of segments [n, length], and expected transitions [2, 2].

    Forward and backward values of a place are scaled to a sum of one.
    """
    n, length = emission.shape
    (p00, p01), (p10, p11) = np.exp(steps)
    e = np.exp(np.clip(emission, -50, 50))
    a0, a1, b0, b1 = np.empty((n, length)), np.empty((n, length)), np.ones((n, length)), np.ones((n, length))
    a1[:, 0] = e[:, 0] / (1 + e[:, 0])
    a0[:, 0] = 1 - a1[:, 0]
    for t in range(1, length):
        x, y = a0[:, t - 1], a1[:, t - 1]
        zero, one = x * p00 + y * p10, (x * p01 + y * p11) * e[:, t]
        toxic = np.where(mask[:, t], one / (zero + one), y)
        a1[:, t], a0[:, t] = toxic, 1 - toxic
    for t in range(length - 2, -1, -1):
        x, y = b0[:, t + 1], b1[:, t + 1] * e[:, t + 1]
        zero, one = p00 * x + p01 * y, p10 * x + p11 * y
        b0[:, t] = np.where(mask[:, t + 1], zero / (zero + one), b0[:, t + 1])
        b1[:, t] = np.where(mask[:, t + 1], one / (zero + one), b1[:, t + 1])
    marginal = np.where(mask, a1 * b1 / (a0 * b0 + a1 * b1), 0.0)
    x, y = b0[:, 1:], b1[:, 1:] * e[:, 1:]
    from0, from1 = a0[:, :-1], a1[:, :-1]
    weight = mask[:, 1:] / (from0 * (p00 * x + p01 * y) + from1 * (p10 * x + p11 * y))
    return marginal, np.array([[(from0 * x * weight).sum() * p00, (from0 * y * weight).sum() * p01], [(from1 * x * weight).sum() * p10, (from1 * y * weight).sum() * p11]])


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model of labelled texts; without both labels all documents score the base rate."""
    flat = Model({}, -5.0, np.zeros((2, 2)), (float(np.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5))), 0.0, 0.0))
    intern = sys.intern
    words = [[intern(w.lower()) for w in WORD.findall(t or "")] for t in texts]
    totals = [len(labels) - sum(labels), sum(labels)]
    if not min(totals):
        return flat
    seen = [Counter(), Counter()]
    for ws, y in zip(words, labels, strict=True):
        if y:
            seen[1].update({f for w in set(ws) for f in features(w)})
    seen[1] = Counter({f: n for f, n in seen[1].items() if n >= LEAST_DOCS})
    for ws, y in zip(words, labels, strict=True):
        if not y:
            seen[0].update({f for w in set(ws) for f in features(w) if f in seen[1]})
    odds = {}
    for f, p in seen[1].items():
        lo = np.log((p + 0.5) / (totals[1] + 1)) - np.log((seen[0][f] + 0.5) / (totals[0] + 1))
        if lo > 1.0:
            odds[f] = float(lo)
    names = sorted(odds, key=lambda f: (-odds[f] * np.sqrt(seen[1][f]), f))[:FEATURES]
    if not names:
        return flat
    index = {f: i for i, f in enumerate(names)}
    cache: dict[str, list[int]] = {}
    rows, cols, gold, keep = [], [], [], 0
    lengths: list[int] = []
    quiet = np.random.default_rng(0)
    for ws, y in zip(words, labels, strict=True):
        for k in range(0, len(ws), SEGMENT):
            part = ws[k : k + SEGMENT]
            found = []
            for t, w in enumerate(part):
                fs = cache.get(w)
                if fs is None:
                    fs = cache[w] = [index[f] for f in features(w) if f in index]
                if fs:
                    found.append((t, fs))
            if not found and quiet.random() > 0.02:
                continue
            line = bytearray(SEGMENT)
            for t, fs in found:
                rows += [keep * SEGMENT + t] * len(fs)
                cols += fs
                line[t] = int(y == 1 and max(odds[names[f]] for f in fs) >= MARKS)
            gold.append(line)
            lengths.append(len(part))
            keep += 1
    del words
    rows, cols, gold = np.array(rows), np.array(cols), np.frombuffer(b"".join(gold), np.uint8).reshape(-1, SEGMENT).astype(float)
    mask = np.arange(SEGMENT) < np.array(lengths)[:, None]
    real = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            real[i, j] = (((gold[:, :-1] == i) & (gold[:, 1:] == j)) * mask[:, 1:]).sum()
    theta = np.zeros(len(names) + 5)
    theta[len(names)] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, ROUNDS + 1):
        w, bias, steps = theta[: len(names)], theta[len(names)], theta[len(names) + 1 :].reshape(2, 2)
        emission = (np.bincount(rows, weights=w[cols], minlength=gold.size)).reshape(gold.shape) + bias
        marginal, moved = _chain(emission, steps, mask)
        off = (marginal - gold * mask).ravel()
        grad = np.concatenate([np.bincount(cols, weights=off[rows], minlength=len(names)), [off.sum()], (moved - real).ravel()]) + RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    model = Model({f: float(x) for f, x in zip(names, theta, strict=False) if abs(x) > 0.05}, float(theta[len(names)]), theta[len(names) + 1 :].reshape(2, 2), (0.0, 0.0, 0.0))
    read = [model.read(t)[:2] for t in texts]
    x = np.array([[1.0, np.log1p(s), most] for s, most in read])
    y, a = np.array(labels, float), np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ a))
        a -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (p - y) + 0.1 * a)
    model.scale = tuple(float(k) for k in a)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most so many labelled documents that are not held out.

    They are those with the smallest hashes of their ids; a null id or label is not used.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_ql_id")).agg(F.max(label).cast("int").alias("_ql_label"))
    chosen = known.filter("_ql_id is not null").orderBy(F.xxhash64("_ql_id"), "_ql_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), docs[doc_id] == F.col("_ql_id")).select("_ql_id", F.col(text).alias("text"), "_ql_label").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["_ql_id"], r["text"] or ""))
    return fit([r["text"] or "" for r in rows], [r["_ql_label"] for r in rows])


def judged(text: Column, model: Model) -> Column:
    """struct(score double, spans array<struct<start int, end int>>) of a text column."""
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf("score double, spans array<struct<start:int,end:int>>")
    def judge(texts: pa.Array) -> pa.Array:
        found = (model.judge(t.as_py()) for t in texts)
        return pa.array([{"score": s, "spans": [{"start": a, "end": b} for a, b in spans]} for s, spans in found], kind)

    return judge(text)


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5) and toxic spans; columns so named go.

    Null and empty texts get the score of a text without toxic words. Rows are kept one for one.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted", "spans")]
    scored = docs.withColumn("_ql_judged", judged(F.col(text), model))
    return scored.select(*kept, F.col("_ql_judged.score").alias("score"), (F.col("_ql_judged.score") >= 0.5).cast("int").alias("predicted"), F.col("_ql_judged.spans").alias("spans"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score, prediction and toxic spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")
