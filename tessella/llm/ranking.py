"""Quality classifier by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (label 1 over label 0).  Weights are
learned by logistic loss on the difference of the two feature vectors, from all
labelled rows: they are dealt to groups, each group's task makes about 40 pairs
a row and sends the gradient and curvature of a Newton step.  The exact quantile
of all their scores at the share of label 0 is the threshold.  A document's
score in 0..1 is the logistic function of its distance to that threshold,
placed so that the threshold is ``CUT``.

Features are statistics of the whole text alone: no label, language, source or
id.  Null and empty texts have all statistics 0 and are scored like any other.
Without a pair to learn from (no labels, or one kind only) every score is 1:
nothing speaks against a document.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.distribution import quantiles
from .common import scratch, table
from .textstats import RATIOS, labelled_statistics, text_statistics

CUT = 0.7
#: Pairs that :func:`fit` makes at most, and pairs of a task of :func:`train` whose differences are in memory at once.
MOST_PAIRS = 100_000
#: Labelled rows of a group on average, and rows of the rarer label that it has at least (copies, where there are fewer).
GROUP, RARE = 5_000, 50
#: Shares are heavy-tailed, so they enter by their square roots; these do not.
PLAIN = ("log_words", "word_length", "line_words")


@dataclass(frozen=True)
class Ranker:
    """``score = 1 / (1 + exp(-(slope * (x @ weights - threshold) + log(CUT / (1 - CUT)))))``."""

    names: tuple
    weights: tuple
    threshold: float
    slope: float = 1.0

    def score(self):
        """The score as one Spark expression over the statistics."""
        if not self.weights:
            return F.lit(1.0)
        raw = sum((F.lit(w) * _feature(n) for n, w in zip(self.names, self.weights, strict=True)), F.lit(0.0))
        return 1 / (1 + F.exp(-(F.lit(self.slope) * (raw - F.lit(self.threshold)) + F.lit(float(np.log(CUT / (1 - CUT)))))))


def _feature(name: str):
    return F.col(name) if name in PLAIN else F.sqrt(F.least(F.col(name), F.lit(1.0)))


def _slopes(d: np.ndarray, w: np.ndarray) -> tuple:
    """Sums over pairs of the loss's gradient and curvature at ``w``."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
    return -(d * p[:, None]).sum(axis=0), (d * (p * (1 - p))[:, None]).T @ d


def _newton(slopes, size: int, ridge: float) -> np.ndarray:
    """Weights of least mean loss; ``slopes(w)``: number of pairs and the sums of :func:`_slopes` over all of them."""
    w = np.zeros(size)
    for _ in range(30):
        n, gradient, curvature = slopes(w)
        step = np.linalg.solve(curvature / n + ridge * np.eye(size), gradient / n + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, names=RATIOS, pairs: int = MOST_PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Learn from features (rows of ``names``, raw statistics) and 0/1 labels."""
    x = np.column_stack([x[:, j] if n in PLAIN else np.sqrt(np.minimum(x[:, j], 1)) for j, n in enumerate(names)])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    if not len(good) or not len(bad):
        return Ranker((), (), 0.0)
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0)
    scale[scale == 0] = 1
    n = min(pairs, len(good) * len(bad), 40 * max(len(good), len(bad)))
    d = (x[rng.choice(good, n)] - x[rng.choice(bad, n)]) / scale
    w = _newton(lambda w: (n, *_slopes(d, w)), x.shape[1], ridge) / scale
    scores = np.sort(x @ w)
    k = len(bad)
    threshold = float((scores[k - 1] + scores[min(k, len(scores) - 1)]) / 2)
    return Ranker(tuple(names), tuple(map(float, w)), threshold)


def train(docs: DataFrame, labels: DataFrame, keep, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """A ranker from all labelled rows for which ``keep(doc_id)`` holds.

    Per step and GROUP rows one gradient and curvature reach the driver.
    """
    with scratch(docs.sparkSession):
        found = labelled_statistics(docs, labels, "quality", keep)
        rows = table(found.select("doc_id", "y", *(_feature(c).alias(c) for c in RATIOS)), "labelled")
        counts = rows.agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") != 1).alias("bad"), *(F.stddev_pop(c).alias(c) for c in RATIOS)).first()
        good, bad = counts["good"], counts["bad"]
        if not good or not bad:
            return Ranker((), (), 0.0)
        scale = np.array([counts[c] or 1.0 for c in RATIOS])
        w = _newton(_pair_slopes(_grouped(rows, good, bad), scale, seed), len(RATIOS), ridge) / scale
        raw = sum((F.lit(float(v)) * F.col(c) for c, v in zip(RATIOS, w, strict=True)), F.lit(0.0))
        # halfway between the scores of rank ``bad`` and the next one
        at = quantiles(rows.select(F.lit(0).alias("all"), raw.alias("raw")), "raw", ("all",), [(bad - 0.5) / (good + bad - 1)]).first()["value"]
        return Ranker(tuple(RATIOS), tuple(map(float, w)), float(at))


def _grouped(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """``rows`` with ``group``: by a hash of their id; those of the rarer label go to several groups where there are few of them."""
    groups = -(-(good + bad) // GROUP)
    copies = min(groups, -(-RARE * groups // min(good, bad)))
    rare = (F.col("y") == 1) if good < bad else (F.col("y") != 1)
    also = F.sequence(F.lit(0), F.when(rare, copies - 1).otherwise(0))
    return rows.withColumn("_j", F.explode(also)).withColumn("group", F.pmod(F.xxhash64("doc_id") + F.col("_j"), F.lit(groups))).drop("_j")


def _pair_slopes(rows: DataFrame, scale: np.ndarray, seed: int):
    """What :func:`_newton` asks for, from pairs within groups; the same pairs each time."""
    names, size, most = list(RATIOS), len(RATIOS), MOST_PAIRS

    def at(w):
        def run(key, pdf):
            pdf = pdf.sort_values(["doc_id", "y", *names])
            x, y = pdf[names].to_numpy(float), pdf["y"].to_numpy()
            good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
            sums = np.zeros(size + size * size)
            n = min(len(good) * len(bad), 40 * max(len(good), len(bad)))
            if n:
                rng = np.random.default_rng(seed + int(key[0]))
                i, j = rng.choice(good, n), rng.choice(bad, n)
                for a in range(0, n, most):
                    gradient, curvature = _slopes((x[i[a : a + most]] - x[j[a : a + most]]) / scale, w)
                    sums += np.concatenate([gradient, curvature.ravel()])
            return pd.DataFrame({"group": [key[0]], "n": [n], "sums": [sums]})

        got = sorted(rows.groupBy("group").applyInPandas(run, "group long, n long, sums array<double>").collect())
        sums = np.sum([r["sums"] for r in got], axis=0)
        return sum(r["n"] for r in got), sums[:size], sums[size:].reshape(size, size)

    return at


def score_documents(docs: DataFrame, ranker: Ranker, *carry: str) -> DataFrame:
    """The columns ``carry`` of ``docs`` with ``score`` and ``predicted`` (1 if score >= CUT, else 0)."""
    scored = text_statistics(docs, *carry).select(*carry, ranker.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def held_out(doc_id):
    """Rows that no label is learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
