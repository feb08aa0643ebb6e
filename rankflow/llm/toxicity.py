"""Toxic passages as maximal-scoring segments.

Learning: log-odds of features between toxic and other labelled texts, with a
Dirichlet prior of a twentieth of the features' counts in both (informative prior);
a feature is certain if its log-odds are some number of standard errors from zero,
that one of `CERTAIN` which does best on texts that did not train the log-odds. Features are words and their first four and five
letters; a word scores by its most certain feature. Words without a certain feature
cost a little, so a text's expected score is negative.

Scoring: a linear-time scan over the word scores finds all maximal segments. Extreme-value
statistics of texts that are not toxic and did not train the log-odds give each segment
its expected number of chance finds, K n exp(-lambda S): lambda is the positive root of
E[exp(lambda s)] = 1 over the histogram of their word scores, K the most likely value
given their best segments and lengths. Significant segments' evidence is summed, and a
logistic curve, fitted on the texts that did not train the log-odds, turns it into a
score from 0 to 1.

Null and empty texts have no evidence and get the curve's lowest value. With no
labelled toxic text at all, all scores are that value. Repeated texts train once;
repeated rows are each scored. Very long texts are scanned whole. An empty table has no
rows. Extra columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_below, judge_texts, map_texts, sample_fraction, written

SAMPLE_DOCS = 9000
CERTAIN = (2.6, 3.2, 4.0, 5.0, 7.0)
PRIOR = 0.05
DRIFT = 0.04
THRESHOLD = 0.7
_WORDS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> tuple[str, ...]:
    """The word itself and, as `*` with the letters, its beginnings."""
    return (word, "*" + word[:4], "*" + word[:5]) if len(word) > 4 else (word, "*" + word) if len(word) == 4 else (word,)


@dataclass
class Segment:
    first: int
    last: int
    score: float


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[Segment]:
    """All maximal-scoring segments of a text, in linear time.

    `scores` has the places and scores of the scored words, ascending; all words
    between them score -drift.
    """
    kept: list[list[float]] = []  # first, last, sum before, sum behind, place in `kept` of the nearest earlier one with a smaller sum before
    total, before = 0.0, 0
    for place, score in scores:
        total -= drift * (place - before)
        before = place + 1
        if score <= 0:
            total += score
            continue
        first, left = place, total
        total += score
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append([first, place, left, total, j])
                break
            first, _, left, _, earlier = kept[j]
            del kept[j:]
            j = earlier
    return [Segment(int(a), int(b), y - x) for a, b, x, y, _ in kept]


def decay(histogram: dict[float, int]) -> float:
    """The positive root of E[exp(lambda s)] = 1 over counted scores; their mean must be negative."""
    scores, counts = np.array(list(histogram), float), np.array(list(histogram.values()), float)
    if not len(scores) or scores.max() <= 0:
        return 60.0
    share = counts / counts.sum()
    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if float((share * np.exp(np.minimum(mid * scores, 700))).sum()) < 1 else (low, mid)
    return max(low, 1e-3)


class Scorer:
    """Word scores, extreme-value constants and the calibration curve."""

    def __init__(self, weights: dict[str, tuple[float, float]], drift: float = DRIFT):
        self.weights, self.drift = weights, drift
        self.slope, self.shift = 1.0, -4.0
        self.lam, self.k = 1.0, 1.0
        self.memo: dict[str, float | None] = {}

    def suit(self, histogram: dict[float | None, int]) -> None:
        """Drift and lambda for counted word scores (None: no certain feature) of texts that aren't toxic.

        The drift is raised where the mean would not be a tenth of the scores' deviation
        below zero, so that chance segments stay short (about a hundred words) beside texts.
        """
        plain = histogram.get(None, 0)
        scored = {s: n for s, n in histogram.items() if s is not None}
        words = plain + sum(scored.values())
        deviation = math.sqrt(sum(s * s * n for s, n in scored.items()) / max(1, words))
        self.drift = max(DRIFT, (sum(s * n for s, n in scored.items()) + 0.1 * deviation * words) / max(1, plain))
        self.lam = decay({**scored, -self.drift: scored.get(-self.drift, 0) + max(1, plain)})

    def word(self, word: str) -> float | None:
        """Score of a word, None for one without a certain feature."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 150_000:
            self.memo.clear()
        found = [w for f in features_of(word) if (w := self.weights.get(f))]
        score = max(found, key=lambda w: abs(w[1]))[0] if found else None
        self.memo[word] = score
        return score

    def segments(self, text: str | None) -> tuple[list[Segment], int]:
        words = _WORDS.findall(text.lower()) if text else []
        memo, get = self.memo, self.word
        scored = [(i, s) for i, w in enumerate(words) if (s := (memo[w] if w in memo else get(w))) is not None]
        return (maximal_segments(scored, self.drift) if scored else []), len(words)

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Summed -log10 of the expected chance finds of significant segments, and their number."""
        found, n = self.segments(text)
        expected = [math.log10(self.k * n) - self.lam * s.score / math.log(10) for s in found]
        real = [-e for e in expected if e < 0]
        return sum(real), len(real)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.sqrt(evidence) + self.shift))))

    def calibrate(self, evidence: np.ndarray, labels: np.ndarray) -> float:
        """Logistic curve over the root of the evidence, by Newton steps with a small ridge; returns its log loss."""
        x = np.stack([np.sqrt(evidence), np.ones(len(evidence))], axis=1)
        beta = np.array([self.slope, self.shift])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            ridge = np.array([1e-2, 1e-2])
            grad = x.T @ (labels - p) - ridge * beta
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
        self.slope, self.shift = float(max(beta[0], 0.0)), float(beta[1])
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ np.array([self.slope, self.shift]), -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).sum())


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Scorer:
    """Fits a scorer on about `sample_docs` distinct texts of (key, text, toxic).

    The sample is chosen by a hash of `key`; two thirds train the word scores, the rest
    the constants and the curve. Feature counts are aggregated by Spark. Every certain
    feature of the sample is in the model, which the sample's size alone bounds.
    """
    known = labelled.where("toxic is not null and text is not null")
    fraction = sample_fraction(known.select("key").count(), sample_docs)
    sample = written(
        known.where(hash_below(F.col("key"), fraction, 5)).groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("key").alias("key")).withColumn("part", F.pmod(F.xxhash64("key", F.lit(9)), F.lit(3))),
        "toxicity-sample",
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                words = set(_WORDS.findall(text.lower()))
                seen[int(toxic > 0)].update({f for w in words for f in features_of(w)})
        both = list(seen[0].keys() | seen[1].keys())
        if both:
            yield pd.DataFrame({"feature": both, "other": [seen[0][f] for f in both], "toxic": [seen[1][f] for f in both]})

    counts = sample.where("part < 2").mapInPandas(count, "feature string, other long, toxic long").groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    counts = written(counts.where(F.col("other") + F.col("toxic") >= 3), "toxicity-features")
    sums = counts.agg(F.sum("other"), F.sum("toxic")).first()
    n0, n1 = float(sums[0] or 0), float(sums[1] or 0)
    if not n0 or not n1:
        return Scorer({})
    prior, whole = (F.col("other") + F.col("toxic")) * PRIOR, (n0 + n1) * PRIOR
    y0, y1 = F.col("other") + prior, F.col("toxic") + prior
    delta = F.log(y1 / (n1 + whole - y1)) - F.log(y0 / (n0 + whole - y0))
    certain = counts.withColumn("delta", delta).withColumn("z", delta / F.sqrt(1 / y0 + 1 / y1)).where(F.abs("z") >= CERTAIN[0])
    rows = certain.select("feature", "delta", "z").collect()  # of the bounded sample
    levels = [x for x in CERTAIN if any(abs(r["z"]) >= x for r in rows)] or [CERTAIN[0]]
    choices = [Scorer({r["feature"]: (r["delta"], r["z"]) for r in rows if abs(r["z"]) >= x}) for x in levels]
    held = sample.where("part = 2").select("text", "toxic")

    def spectrum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                for word, n in Counter(_WORDS.findall(text.lower())).items():
                    for i, c in enumerate(choices):
                        s = c.word(word)
                        seen[i, None if s is None else round(s, 2)] += n
        yield pd.DataFrame({"level": [k[0] for k in seen], "score": pd.Series([k[1] for k in seen], dtype="float64"), "n": list(seen.values())})

    usual = held.where("toxic = 0").mapInPandas(spectrum, "level int, score double, n long").groupBy("level", "score").agg(F.sum("n").alias("n")).collect()
    for i, c in enumerate(choices):
        c.suit({None if r["score"] is None or r["score"] != r["score"] else r["score"]: r["n"] for r in usual if r["level"] == i})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, texts = [0.0] * len(choices), 0
        for pdf in batches:
            for text in pdf["text"]:
                texts += 1
                for i, c in enumerate(choices):
                    found, n = c.segments(text)
                    sums[i] += n * math.exp(-c.lam * max((s.score for s in found), default=0.0))
        yield pd.DataFrame({"level": range(len(choices)), "total": sums, "texts": texts})

    extremes = held.where("toxic = 0").mapInPandas(best, "level int, total double, texts long").groupBy("level").agg(F.sum("total").alias("total"), F.sum("texts").alias("texts")).collect()
    for r in extremes:  # P(best < x) = exp(-K n exp(-lambda x)) is most likely for this K
        choices[r["level"]].k = max(1e-6, r["texts"] / r["total"]) if r["total"] else 1.0

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"evidence": [[c.evidence(t)[0] for c in choices] for t in pdf["text"]], "toxic": pdf["toxic"]})

    seen = held.mapInPandas(judge, "evidence array<double>, toxic int").toPandas()  # about a third of the bounded sample
    if not len(seen):
        return choices[0]
    labels = (seen["toxic"] > 0).to_numpy(float)
    losses = [c.calibrate(np.array([e[i] for e in seen["evidence"]], float), labels) for i, c in enumerate(choices)]
    return choices[int(np.argmin(losses))]


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Per row (doc_id, text): doc_id, score (0 to 1), predicted (1 from the threshold on) and n_passages."""
    return judged(docs.select("doc_id", "text"), scorer, "found").select("doc_id", "found.*")


def judged(docs: DataFrame, scorer: Scorer, name: str) -> DataFrame:
    """All columns and the struct `name` of score, predicted and n_passages; no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def judge(texts: list) -> pd.DataFrame:
        own = shared.value
        found = [own.evidence(t) for t in texts]
        scores = np.array([own.score(e) for e, _ in found], float)
        return pd.DataFrame({"score": scores, "predicted": (scores >= THRESHOLD).astype("int32"), "n_passages": np.array([n for _, n in found], np.int64)})

    return judge_texts(docs, judge, "score double, predicted int, n_passages long", name)


def passages(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Per significant passage: doc_id, first and last word, segment score and expected number of chance finds."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found, n = own.segments(text)
                rows += [(doc_id, s.first, s.last, s.score, e) for s in found if (e := own.k * n * math.exp(-own.lam * s.score)) < 1]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "first_word", "last_word", "score", "expected"])

    return map_texts(docs, run, "first_word long, last_word long, score double, expected double")
