"""Morphology of small grids, boundary distances, discrete alignment and envelope order.

Only already aggregated cells of one section come together in a task, at most
the grid cap; objects never do.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import FLIPS, percent


def _shifted(mask, fill=False):
    """The mask moved one cell in each of four directions."""
    p = np.pad(mask, 1, constant_values=fill)
    return p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]


def dilate(mask, times: int = 1):
    for _ in range(times):
        mask = mask | np.logical_or.reduce(_shifted(mask))
    return mask


def erode(mask, times: int = 1):
    """Outside counts as background."""
    for _ in range(times):
        mask = mask & np.logical_and.reduce(_shifted(mask))
    return mask


def close(mask, times: int = 1):
    return erode(dilate(mask, times), times)


def label(mask):
    """4-connected components, numbered from 1 in row order of their first cell."""
    out, n = np.zeros(mask.shape, dtype=int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        out[start], stack = n, [start]
        while stack:
            y, x = stack.pop()
            for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not out[v, u]:
                    out[v, u] = n
                    stack.append((v, u))
    return out, n


def fill_holes(mask):
    """Background that does not reach the edge becomes foreground."""
    p = np.pad(~mask, 1, constant_values=True)
    parts, _ = label(p)
    return ~(parts == parts[0, 0])[1:-1, 1:-1]


def _largest(mask):
    parts, n = label(mask)
    if not n:
        return None
    return parts == 1 + int(np.argmax(np.bincount(parts.ravel())[1:]))


def void_cells(occupied, least: int = 6):
    """The largest hole of the twice closed support, if it has ``least`` cells; else None."""
    closed = close(occupied, 2)
    hole = _largest(fill_holes(closed) & ~closed)
    return hole if hole is not None and hole.sum() >= least else None


def outline(mask):
    """Vertices of the half-level contour about a hole-free 4-connected mask: midpoints between in- and outside cells, in order (x, y)."""
    h, w = mask.shape
    inside = lambda y, x: 0 <= y < h and 0 <= x < w and mask[y, x]
    y0, x0 = map(int, np.argwhere(mask)[0])
    side, at, path = 0, (y0, x0), []
    around = ((-1, 0), (0, 1), (1, 0), (0, -1))  # up, right, down, left
    while True:
        y, x = at
        dy, dx = around[side]
        path.append((x + 0.5 + dx / 2, y + 0.5 + dy / 2))
        fy, fx = around[(side + 1) % 4]
        if inside(y + fy + dy, x + fx + dx) and inside(y + fy, x + fx):
            at, side = (y + fy + dy, x + fx + dx), (side - 1) % 4
        elif inside(y + fy, x + fx):
            at = (y + fy, x + fx)
        else:
            side = (side + 1) % 4
        if at == (y0, x0) and side == 0:
            return path


def boundary_cells(occupied):
    """Cells of the closed support's largest component that touch its outside (padded by 2, so the edge is outside)."""
    body = _largest(close(np.pad(occupied, 2), 1))
    return None if body is None else (body & ~erode(body))[2:-2, 2:-2]


def squared_distance(outside):
    """Squared distance, in cells, of each cell to the nearest one of a mask (which has one).

    Separable: first along each column, then the least over the columns at each
    offset, up to the greatest distance found; every step is one array operation.
    """
    h, w = outside.shape
    far = h + w
    near = np.where(outside, 0, far)
    for y in range(1, h):
        near[y] = np.minimum(near[y], near[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        near[y] = np.minimum(near[y], near[y + 1] + 1)
    column = near.astype(np.int64) ** 2
    out = column.copy()
    for d in range(1, w):
        if d * d >= out.max():
            break
        np.minimum(out[:, d:], column[:, :-d] + d * d, out=out[:, d:])
        np.minimum(out[:, :-d], column[:, d:] + d * d, out=out[:, :-d])
    return out


def clearance(occupied, width: float):
    """Distance of each supported cell's centre to the outside, less half a cell's diagonal; the grid is padded by one cell."""
    d2 = squared_distance(~np.pad(occupied, 1))[1:-1, 1:-1]
    return np.where(occupied, np.sqrt(d2) * width - width * math.sqrt(2) / 2, np.nan)


def _mask(pdf: pd.DataFrame):
    mask = np.zeros((int(pdf["iy"].max()) + 1, int(pdf["ix"].max()) + 1), dtype=bool)
    on = pdf[pdf["n"] > 0]
    mask[on["iy"].astype(int), on["ix"].astype(int)] = True
    return mask


def centroid_inside(points: list):
    """The centroid ``(x, y)`` of a polygon; None where it is degenerate or lies outside (even-odd rule)."""
    x, y = np.array(points, dtype=float).T
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    cross = x * ny - nx * y
    if abs(cross.sum()) < 1e-10:
        return None
    cx, cy = ((x + nx) * cross).sum() / (3 * cross.sum()), ((y + ny) * cross).sum() / (3 * cross.sum())
    rise = np.where(ny == y, 1.0, ny - y)
    inside = ((y > cy) != (ny > cy)) & (cx < (nx - x) * (cy - y) / rise + x)
    return (float(cx), float(cy)) if inside.sum() % 2 else None


def candidate_voids(grid: DataFrame, width: float, least: int = 6, job: str = "job") -> DataFrame:
    """``(job, cells, polygon, centroid)`` of dense cell counts ``(job, ix, iy, n, x0, y0)``.

    No row where there is no void, or where its centroid lies outside its outline.
    """

    def run(key, pdf):
        hole, rows = void_cells(_mask(pdf), least), {"job": [], "cells": [], "polygon": [], "centroid": []}
        if hole is not None:
            x0, y0 = pdf["x0"].iloc[0], pdf["y0"].iloc[0]
            points = [(float(x0 + x * width), float(y0 + y * width)) for x, y in outline(hole)]
            if (centre := centroid_inside(points)) is not None:
                point = lambda p: {"x": p[0], "y": p[1]}
                rows = {"job": [key[0]], "cells": [int(hole.sum())], "polygon": [list(map(point, points))], "centroid": [point(centre)]}
        return pd.DataFrame({k: pd.Series(v, dtype=object if k in ("polygon", "centroid") else None) for k, v in rows.items()})

    return grid.groupBy(job).applyInPandas(run, f"job {dict(grid.dtypes)[job]}, cells long, polygon array<struct<x:double,y:double>>, centroid struct<x:double,y:double>")


def boundaries(grid: DataFrame, width: float, job: str = "job") -> DataFrame:
    """``(job, x, y)``: centres of boundary cells."""

    def run(key, pdf):
        edge = boundary_cells(_mask(pdf))
        at = np.argwhere(edge) if edge is not None else np.empty((0, 2))
        return pd.DataFrame({"job": [key[0]] * len(at), "x": pdf["x0"].iloc[0] + (at[:, 1] + 0.5) * width, "y": pdf["y0"].iloc[0] + (at[:, 0] + 0.5) * width})

    return grid.groupBy(job).applyInPandas(run, f"job {dict(grid.dtypes)[job]}, x double, y double")


def clearances(grid: DataFrame, width: float, job: str = "job") -> DataFrame:
    """``(job, ix, iy, clearance)`` of supported cells."""

    def run(key, pdf):
        c = clearance(_mask(pdf), width)
        at = np.argwhere(~np.isnan(c))
        return pd.DataFrame({"job": [key[0]] * len(at), "ix": at[:, 1], "iy": at[:, 0], "clearance": c[at[:, 0], at[:, 1]] if len(at) else []})

    return grid.groupBy(job).applyInPandas(run, f"job {dict(grid.dtypes)[job]}, ix long, iy long, clearance double")


#: Entries of a table of column distances that is held at a time.
TABLE = 4_000_000


def nearest_distances(points, others):
    """Distance of each point to the nearest of ``others``, both ``(n, 2)`` arrays; exact.

    Boundaries lie on grids: the others are few columns, the points few rows.
    The least distance within every column is found once for every row; a point
    then goes through columns from its own place outwards and stops as soon as
    the next one alone is farther than what it has.
    """
    columns, col = np.unique(others[:, 0], return_inverse=True)
    rows, row = np.unique(points[:, 1], return_inverse=True)
    y = others[np.lexsort((others[:, 1], col)), 1]
    starts = np.searchsorted(np.sort(col), np.arange(len(columns) + 1))
    n, out = len(columns), np.empty(len(points))
    per = max(1, TABLE // n)
    for first in range(0, len(rows), per):
        part = rows[first : first + per]
        table = np.empty((len(part), n))
        for c in range(n):
            of = y[starts[c] : starts[c + 1]]
            at = np.searchsorted(of, part)
            table[:, c] = np.minimum(np.abs(part - of[np.maximum(at - 1, 0)]), np.abs(part - of[np.minimum(at, len(of) - 1)]))
        table *= table
        who = np.flatnonzero((row >= first) & (row < first + per))
        r, x = row[who] - first, points[who, 0]
        place, best = np.searchsorted(columns, x), np.full(len(who), np.inf)
        live, step = np.arange(len(who)), 0
        gap = lambda k, at: np.where((at >= 0) & (at < n), np.abs(columns[np.clip(at, 0, n - 1)] - x[k]), np.inf)  # noqa: B023, E731
        while len(live):
            for at in (place[live] + step, place[live] - 1 - step):
                ok = (at >= 0) & (at < n)
                k, c = live[ok], at[ok]
                best[k] = np.minimum(best[k], (columns[c] - x[k]) ** 2 + table[r[k], c])
            step += 1
            next_gap = np.minimum(gap(live, place[live] + step), gap(live, place[live] - 1 - step))
            live = live[next_gap**2 < best[live]]
        out[who] = np.sqrt(best)
    return out


def _trimmed(distances, retained: float):
    """The mean of the ``ceil(retained * n)`` least, and the 90th percentile."""
    kept = np.sort(distances)[: math.ceil(retained * len(distances))]
    return kept.mean(), np.percentile(distances, 90)


def _score(mine, theirs, retained: float):
    there, back = _trimmed(nearest_distances(mine, theirs), retained), _trimmed(nearest_distances(theirs, mine), retained)
    return (there[0] + back[0]) / 2, max(there[1], back[1])


def boundary_scores(a: DataFrame, b: DataFrame, keys, retained: float = 0.8) -> DataFrame:
    """Symmetric trimmed boundary distance and tail per pair of boundaries ``(keys, x, y)``.

    ``score`` averages both ways the mean of the ``ceil(retained * n)`` closest
    distances; ``tail`` is the greater 90th percentile.  A pair is two
    boundaries of capped grids and is one task's; no pairs of their cells are made.
    """
    keys = list(keys)

    def run(key, p, q):
        if not len(p) or not len(q):
            return pd.DataFrame({c: [] for c in (*keys, "score", "tail")})
        score, tail = _score(*(np.unique(d[["x", "y"]].to_numpy(float), axis=0) for d in (p, q)), retained)
        return pd.DataFrame([(*key, score, tail)], columns=[*keys, "score", "tail"])

    kinds = dict(a.dtypes)
    a, b = (d.select(*keys, "x", "y") for d in (a, b))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "score double, tail double"]))


def flip_scores(edges: DataFrame, reference: DataFrame, retained: float = 0.8, job: str = "job") -> DataFrame:
    """``(job, orientation, score, tail)``: every flip of each section's boundary against the reference's.

    ``edges``: ``(job, x, y)`` and ``reference``: ``(x, y)``, both about their
    centres.  A section's boundary is one value of at most the grid cap, the
    reference's goes to every section once.  A flip is its own inverse and keeps
    distances, so a section's cells are measured against the reference's under
    each flip, and the reference's, flipped, against the section's own.
    """
    point, flips = F.collect_list(F.struct("x", "y")), dict(FLIPS)
    one = reference.agg(point.alias("_theirs"))
    both = edges.groupBy(job).agg(point.alias("_mine")).crossJoin(F.broadcast(one))  # one row, of capped size

    def run(batches):
        for pdf in batches:
            out = []
            for key, mine, theirs in zip(pdf[job], pdf["_mine"], pdf["_theirs"], strict=True):
                p, q = (np.unique(np.array([(v["x"], v["y"]) for v in points], float), axis=0) if len(points) else None for points in (mine, theirs))
                if p is not None and q is not None:
                    out += [(key, name, *_score(p * np.array(sign), q, retained)) for name, sign in flips.items()]
            yield pd.DataFrame(out, columns=[job, "orientation", "score", "tail"])

    return both.mapInPandas(run, f"`{job}` {dict(edges.dtypes)[job]}, orientation string, score double, tail double")


def allowed_flip(orientation, dy, reference_dy):
    """Whether an orientation puts a cue on the reference's side; without either cue all are allowed."""
    sy = None
    for name, (_, s) in FLIPS.items():
        hit = F.col(orientation) == name
        sy = F.when(hit, s) if sy is None else sy.when(hit, s)
    known = F.col(dy).isNotNull() & F.col(reference_dy).isNotNull() & (F.col(dy) != 0) & (F.col(reference_dy) != 0)
    return ~known | (F.signum(sy * F.col(dy)) == F.signum(F.col(reference_dy)))


def alignment_proposals(edges: DataFrame, centres: DataFrame, reference, ambiguous: float = 0.1, job: str = "job") -> DataFrame:
    """The flip of each section whose boundary lies nearest to the reference section's, about their centres.

    ``edges``: ``(job, x, y)``; ``centres``: ``(job, cx, cy[, cue_dy])``.  Ties
    follow the order of FLIPS.  ``margin`` is the lead over the next best allowed
    flip, relative to that one's score (to 1 at least); below ``ambiguous`` the
    proposal is ambiguous.  It is never an approval.
    """
    spark = edges.sparkSession
    if "cue_dy" not in centres.columns:
        centres = centres.withColumn("cue_dy", F.lit(None).cast("double"))
    flips = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(FLIPS)], "orientation string, place int"))
    about = edges.join(centres, job).select(job, (F.col("x") - F.col("cx")).alias("x"), (F.col("y") - F.col("cy")).alias("y"))
    scores = flip_scores(about.where(F.col(job) != reference), about.where(F.col(job) == reference).select("x", "y"), job=job)
    cue = centres.where(F.col(job) == reference).select(F.col("cue_dy").alias("reference_dy"))
    scores = scores.join(centres.select(job, "cue_dy"), job).crossJoin(cue).join(flips, "orientation")
    scores = scores.withColumn("_score", F.round("score", 9))  # flips of a symmetric boundary tie, whatever the order of the sums
    best_any = Window.partitionBy(job).orderBy("_score", "place")
    scores = scores.withColumn("allowed", allowed_flip("orientation", "cue_dy", "reference_dy")).withColumn("any", F.row_number().over(best_any))
    w = Window.partitionBy(job, "allowed").orderBy("_score", "place")
    ranked = scores.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("margin", (F.col("next") - F.col("score")) / F.greatest(F.col("next"), F.lit(1.0)))
    chosen = ranked.where("allowed and r = 1")
    return chosen.select(job, "orientation", "score", "tail", "margin", F.coalesce(F.col("margin") < ambiguous, F.lit(False)).alias("ambiguous"), (F.col("any") != 1).alias("cue_conflict"), F.lit(False).alias("approved"))


def stability(fine: DataFrame, coarse: DataFrame, job: str = "job") -> DataFrame:
    """Whether two resolutions propose the same flip."""
    a, b = (d.select(job, F.col("orientation").alias(n)) for d, n in ((fine, "fine"), (coarse, "coarse")))
    return a.join(b, job).withColumn("stable", F.col("fine") == F.col("coarse"))


def layout_audit(objects: DataFrame, image: str = "arm", job: str = "job") -> DataFrame:
    """Within an image: extents of both groups along x, their order, and the contrast of association.

    The order is known only if the envelopes are strictly apart.
    """
    a = F.col("object_type") == "A"
    per = objects.groupBy(image, "grp", job).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.when(F.count_if(a) == F.count_if(a & F.col("b_present").isNotNull()), 100 * F.avg(F.when(a, F.col("b_present").cast("int")))).alias("rate"))
    side = lambda g, f, c: f(F.when(F.col("grp") == g, F.col(c)))
    full = lambda g: F.when(F.count_if(F.col("grp") == g) == F.count(F.when(F.col("grp") == g, F.col("rate"))), side(g, F.avg, "rate"))
    out = per.groupBy(image).agg(side("control", F.min, "lo").alias("control_lo"), side("control", F.max, "hi").alias("control_hi"), side("treated", F.min, "lo").alias("treated_lo"), side("treated", F.max, "hi").alias("treated_hi"), (full("control") - full("treated")).alias("contrast"))
    order = F.when(F.col("control_hi") < F.col("treated_lo"), "control lower").when(F.col("treated_hi") < F.col("control_lo"), "treated lower").otherwise("overlap")
    gap = F.greatest(F.col("treated_lo") - F.col("control_hi"), F.col("control_lo") - F.col("treated_hi"))
    return out.withColumn("x_order", order).withColumn("gap", F.when(gap > 0, gap))


def section_extents(objects: DataFrame, keys=("arm", "image", "grp", "animal", "job")) -> DataFrame:
    """Per section the extents of its boxes, both classes together, their mid-points and sizes, counts, and the association of class A.

    An unknown flag, or no object of class A, makes the association unknown.
    """
    a = F.col("object_type") == "A"
    known = (F.count_if(a) > 0) & (F.count_if(a) == F.count_if(a & F.col("b_present").isNotNull()))
    out = objects.groupBy(*keys).agg(
        *(f(f"{c}{side}").alias(f"{c}_{side}") for c in ("x", "y") for f, side in ((F.min, "min"), (F.max, "max"))),
        F.count("*").alias("n_objects"), F.count_if(a).alias("n_a"), F.when(known, F.count_if(a & F.col("b_present"))).alias("n_positive"),
    )
    sized = {f"{c}_{name}": e for c in ("x", "y") for name, e in (("mid", (F.col(f"{c}_min") + F.col(f"{c}_max")) / 2), ("size", F.col(f"{c}_max") - F.col(f"{c}_min")))}
    return out.withColumns(sized | {"association_pct": percent("n_positive", "n_a")})


def layout_contrasts(extents: DataFrame, keys=("arm", "image")) -> DataFrame:
    """Within each image: sections and replicates of both groups, their contrast where all are known, and the order of their x extents.

    ``gap`` is how far the groups lie apart along x, 0 where they meet; it and
    the order need both groups.
    """
    side = lambda g, f, c: f(F.when(F.col("grp") == g, F.col(c)))
    names = lambda g: F.concat_ws(", ", F.sort_array(F.collect_list(F.when(F.col("grp") == g, F.col("animal").cast("string")))))
    whole = F.greatest(*(F.count_if(F.col("grp") == g) == 0 for g in ("control", "treated"))) | (F.count("association_pct") < F.count("*"))
    per = extents.groupBy(*keys).agg(
        *(x for g in ("control", "treated") for x in (names(g).alias(f"{g}_animals"), F.count_if(F.col("grp") == g).alias(f"n_{g}"), F.when(~whole, side(g, F.avg, "association_pct")).alias(f"{g}_mean"))),
        *(side(g, f, f"x_{n}").alias(f"_{g}_{n}") for g in ("control", "treated") for f, n in ((F.min, "min"), (F.max, "max"))),
    )
    low, high = F.col("_treated_min") - F.col("_control_max"), F.col("_control_min") - F.col("_treated_max")
    order = F.when(low.isNull() | high.isNull(), "one group").when(low > 0, "control lower").when(high > 0, "treated lower").otherwise("overlap")
    gap = F.when(low.isNotNull() & high.isNotNull(), F.greatest(low, high, F.lit(0.0)))
    return per.withColumn("difference", F.col("control_mean") - F.col("treated_mean")).withColumn("x_order", order).withColumn("gap", gap).drop(*(c for c in per.columns if c.startswith("_")))


def layout_verdict(extents: DataFrame, keys=("arm", "image")) -> DataFrame:
    """One row over all images: whether the groups are apart along x in the same order everywhere, and how many contrasts point each way.

    ``order`` is unknown unless it is the same, and strict, in every image.
    """
    each = layout_contrasts(extents, keys)
    apart = F.col("x_order").isin("control lower", "treated lower")
    same = (F.count("*") > 0) & (F.count_if(apart) == F.count("*")) & (F.min("x_order") == F.max("x_order"))
    d = F.col("difference")
    verdict = each.agg(
        F.count("*").alias("n_comparisons"), F.coalesce(same, F.lit(False)).alias("consistent"), F.when(same, F.min("x_order")).alias("order"), F.count(d).alias("n_known"),
        F.count_if(d > 0).alias("n_positive_contrasts"), F.count_if(d < 0).alias("n_negative_contrasts"), ((F.count("*") > 0) & (F.count_if(d > 0) == F.count("*"))).alias("all_positive"),
    )
    ends = [f(F.when(F.col("grp") == g, F.col(f"x_{n}"))).alias(f"{g}_x_{n}") for g in ("control", "treated") for f, n in ((F.min, "min"), (F.max, "max"))]
    sections = extents.agg(F.count("*").alias("n_sections"), F.countDistinct(keys[-1]).alias("n_images"), *ends)
    return sections.crossJoin(F.broadcast(verdict))  # one row each
