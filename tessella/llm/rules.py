"""Quality rules as a learned decision list.

Sequential covering (after IREP): a rule for rejecting is grown on two thirds
of the labelled statistics by the threshold condition of greatest FOIL gain,
pruned from its end on the other third, and accepted while it is right often
enough there; what it covers is set aside and the next rule is grown.  The
list becomes one ordered Spark conditional expression.

Fixed base rules come first: too few words, or too many repeated ones.  Null
and empty texts have no words and fail them.  Without labels of both kinds the
list is empty and only the base rules reject.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import COUNTS, RATIOS, labelled_sample, text_statistics

MOST_ROWS = 20_000
MIN_PRECISION, MIN_COVER, MAX_CONDITIONS, MAX_RULES, CUTS = 0.9, 3, 4, 24, 128
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30


def _cuts(values: np.ndarray) -> np.ndarray:
    """Midpoints of neighbouring values, CUTS at most, evenly over the ranks."""
    v = np.unique(values)
    mids = (v[:-1] + v[1:]) / 2
    return mids if len(mids) <= CUTS else mids[np.linspace(0, len(mids) - 1, CUTS).astype(int)]


def _covers(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, cut in rule:
        out &= x[:, j] > cut if above else x[:, j] <= cut
    return out


def _grow(x, bad):
    """Conditions (feature, above?, cut) until only bad rows are covered."""
    rule, live = [], np.ones(len(x), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (live & ~bad).any():
        p0, n0 = (live & bad).sum(), (live & ~bad).sum()
        best = (0.0, None)
        base = np.log2(p0 / (p0 + n0)) if p0 else 0
        for j in range(x.shape[1]):
            values, isbad = x[live, j], bad[live]
            cuts = _cuts(values)
            order = np.argsort(values)
            below_bad = np.concatenate([[0], isbad[order].cumsum()])
            k = np.searchsorted(values[order], cuts, side="right")
            for above in (True, False):
                p = p0 - below_bad[k] if above else below_bad[k]
                n = (len(values) - k if above else k) - p
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (float(gain.max()), (j, above, float(cuts[gain.argmax()])))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _covers(rule[-1:], x)
    return rule


def learn(x: np.ndarray, y: np.ndarray, names=RATIOS) -> list:
    """Rules, in order, each a list of ``(name, above?, cut)``; a covered row is rejected."""
    bad, rules = y != 1, []
    held = np.arange(len(x)) % 3 == 2
    live = np.ones(len(x), dtype=bool)
    while len(rules) < MAX_RULES and (live & ~held & bad).sum() >= MIN_COVER:
        rule = _grow(x[live & ~held], bad[live & ~held])
        t, b = x[live & held], bad[live & held]

        def worth(r):
            c = _covers(r, t)
            return ((c & b).sum() - (c & ~b).sum()) / max(1, c.sum()), (c & b).sum()  # noqa: B023

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covers(rule, x) & live
        if not rule or c.sum() < MIN_COVER or (c & bad).sum() < MIN_PRECISION * c.sum() or (c & held & bad).sum() < MIN_PRECISION * (c & held).sum():
            break
        rules.append(rule)
        live &= ~c
    return [[(names[j], above, cut) for j, above, cut in rule] for rule in rules]


def train(docs: DataFrame, labels: DataFrame, keep=lambda _: F.lit(True), most: int = MOST_ROWS) -> list:
    """Rules from at most ``most`` labelled rows for which ``keep(doc_id)`` holds."""
    sample = text_statistics(labelled_sample(docs, labels, "quality", keep, most), "doc_id", "y")
    rows = sorted(map(tuple, sample.select("doc_id", "y", *RATIOS).collect()))
    table = np.array(rows, dtype=float).reshape(-1, 2 + len(RATIOS))
    return learn(table[:, 2:], table[:, 1])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def verdict(rules: list) -> Column:
    """The ordered conditional: the number (from 1) of the first rule that rejects, 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for name, above, cut in rule:
            holds = holds & (F.col(name) > cut if above else F.col(name) <= cut)
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def apply_rules(docs: DataFrame, rules: list, *carry: str) -> DataFrame:
    """The columns ``carry`` of ``docs`` with COUNTS, ``base_failed``, ``rule`` and ``kept``."""
    out = text_statistics(docs, *carry).select(*carry, *COUNTS, base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
