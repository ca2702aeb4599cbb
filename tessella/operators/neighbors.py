"""Exact nearest neighbours by cells that fit the densest place and grow with the distance.

Rows of one place are one question and one answer: distances are found for the
distinct places of the queries and joined to their rows at the end, so that
neither ids nor repeated places move with the cells.  Both sides are bucketed
by ``width``, at which no cell holds more than DENSE places of targets; where
objects lie thinner, the coarser levels below stand for wider cells, so that
every query meets cells that fit its surroundings.  Queries first meet the
objects in the cells that lie within REACH of a width (a place that is itself a
target's: in its own cell); a distance of at most that is then final, since
anything outside is farther.  For the others, in regions without objects, cells
are coarsened by GROW a level: the level at which one of the nine cells about
the query is occupied bounds the distance, and only occupied cells within that
bound are descended to their objects.  So a query far from all objects costs a
few cells a level, not an area, and every join is an equi-join on cells.  A
group without targets has NULL distances, and so has a query without a place.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bin_index
from .distribution import kept

#: Cells along each side that make one cell of the next level, and distinct places of targets that a cell may hold.
GROW, DENSE = 4, 64
#: Targets in an average cell, and the share of a width within which other cells are looked at first.  A query goes to
#: about (1 + 2 * REACH) ** 2 cells; where targets are spread evenly, one in 500 finds none within that distance.
OCCUPANCY, REACH = 8.0, 0.5


def fitting_width(targets: DataFrame, keys=("job",), occupancy: float = 2.0) -> float:
    """A cell width at which a cell of the average group holds about ``occupancy`` targets; from one row per group."""
    per = targets.groupBy(*keys).agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("a"), F.count("*").alias("n"))
    area, n = per.agg(F.sum("a"), F.sum("n")).first()
    return (occupancy * area / n) ** 0.5 if n and area and area > 0 else 1.0


def adapted_width(places: DataFrame, keys=("job",)) -> float:
    """:func:`fitting_width`, divided by GROW until no cell holds more than DENSE of the distinct ``places``."""
    width = fitting_width(places, keys, OCCUPANCY)
    for _ in range(40):
        most = _cells(places, width).groupBy(*keys, "cx", "cy").count().agg(F.max("count")).first()[0] or 0
        if most <= DENSE:
            break
        width /= GROW ** max(1, math.ceil(math.log(most / DENSE, GROW * GROW)))  # as many steps as even a full cell needs
    return width


def _cells(df: DataFrame, width: float) -> DataFrame:
    return df.withColumn("cx", bin_index("x", F.lit(0.0), width)).withColumn("cy", bin_index("y", F.lit(0.0), width))


def _around(rows: DataFrame, reach: int) -> DataFrame:
    """Each row once for every cell at most ``reach`` away."""
    span = F.array(*(F.lit(i).cast("long") for i in range(-reach, reach + 1)))
    rows = rows.withColumn("_i", F.explode(span)).withColumn("_j", F.explode(span))
    return rows.withColumn("cx", F.col("cx") + F.col("_i")).withColumn("cy", F.col("cy") + F.col("_j")).drop("_i", "_j")


def _distance(dx, dy):
    return F.sqrt(dx * dx + dy * dy)


def _scale(level):
    """Cells along the side of a cell of a level; powers of two, so exact."""
    return F.pow(F.lit(float(GROW)), level.cast("double"))


def _coarse(c, level):
    return F.floor(F.col(c) / _scale(level)).cast("long")


def nearest(queries: DataFrame, targets: DataFrame, width: float | None = None, keys=("job",), id_column: str = "object_id", places: bool = False) -> DataFrame:
    """``(keys, id, distance)`` for every row of ``queries`` (``x``, ``y``); by default the width fits the targets' densest places.

    Rows that repeat id and place are one.  ``places``: with ``x`` and ``y``.
    """
    keys = list(keys)
    rows = queries.select(*keys, id_column, "x", "y").distinct()
    found = place_distances(queries, targets, width, keys)
    found = found.select(*(F.col(c).alias(f"_{c}") for c in (*keys, "x", "y")), "distance")
    # null-safe, though places are known: else filters on them move below and work the places out once more
    same = [*(F.col(k) == F.col(f"_{k}") for k in keys), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("x", "y"))]
    return rows.join(found, same, "left").select(*keys, id_column, *(("x", "y") if places else ()), "distance")


def place_distances(queries: DataFrame, targets: DataFrame, width: float | None = None, keys=("job",)) -> DataFrame:
    """``(keys, x, y, distance)`` of the distinct places of ``queries`` in groups that have targets; computed here, once."""
    keys = list(keys)
    at = [*keys, "x", "y"]
    held = kept(targets.select(*at).distinct()).where("x is not null and y is not null")  # filtered here, not where the places are computed
    width = float(adapted_width(held, keys) if width is None else width)
    t = _cells(held, width).withColumnRenamed("x", "tx").withColumnRenamed("y", "ty")
    asked = queries.select(*at).distinct().join(held.withColumn("_same", F.lit(True)), at, "left")
    reach = REACH * width
    q = _reached(asked.withColumn("_reach", F.when(F.col("_same"), 0.0).otherwise(reach)), width)
    near = kept(q.join(t, [*keys, "cx", "cy"], "left").groupBy(*at).agg(F.min(_gap()).alias("distance")))
    final = F.coalesce(F.col("distance") <= reach * (1 - 1e-9), F.lit(False))  # edges are rounded
    done, left = near.where(final), near.where(~final).select(*at).join(F.broadcast(held.select(*keys).distinct()), keys)  # one row per group
    levels = _levels(_cells(left, width), t)
    return done if levels is None else done.unionByName(kept(_far(left, t, width, levels, keys, at)))


def _reached(rows: DataFrame, width: float) -> DataFrame:
    """Each row once for every cell that is not farther than its ``_reach`` along either side; a row without a place has no cell."""
    for c in ("x", "y"):
        ends = (bin_index(F.col(c) + sign * F.col("_reach"), F.lit(0.0), width) for sign in (-1, 1))
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(*ends)))
    return rows.drop("_reach", "_same")


def _gap():
    return _distance(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))


def _far(left: DataFrame, t: DataFrame, width: float, levels: int, keys: list, query: list) -> DataFrame:
    """Distances of the places that no object is near."""
    at = [*keys, "level", "cx", "cy"]
    steps = F.array(*(F.lit(k) for k in range(levels + 1)))
    occupied = t.select(*keys, "cx", "cy").distinct().withColumn("level", F.explode(steps))
    occupied = occupied.select(*keys, "level", *(_coarse(c, F.col("level")).alias(c) for c in ("cx", "cy"))).distinct()
    place = lambda rows: rows.select(*query, "level", *(F.floor(F.col(c) / (width * _scale(F.col("level")))).cast("long").alias(f"c{c}") for c in ("x", "y")))

    # the lowest level at which an occupied cell touches the query's own; the nearest object is then less than 3 of its cells away
    first = _around(place(left.withColumn("level", F.explode(F.slice(steps, 2, levels)))), 1).join(occupied, at).groupBy(*query).agg(F.min("level").alias("level"))
    cells = _bounded(_around(place(first), 3).join(occupied, at), width, query)
    for level in range(levels, 0, -1):
        down = F.col("level") == level
        children = F.when(down, F.array(*(F.lit(i).cast("long") for i in range(GROW)))).otherwise(F.array(F.lit(0).cast("long")))
        cells = cells.withColumn("_i", F.explode(children)).withColumn("_j", F.explode(children))
        inner = lambda c, i: F.when(down, F.col(c) * GROW + F.col(i)).otherwise(F.col(c)).alias(c)  # noqa: B023, E731
        cells = cells.select(*query, F.when(down, level - 1).otherwise(F.col("level")).alias("level"), inner("cx", "_i"), inner("cy", "_j"))
        cells = _bounded(cells.join(occupied, at), width, query)
    return cells.join(t, [*keys, "cx", "cy"]).groupBy(*query).agg(F.min(_gap()).alias("distance"))


def _bounded(cells: DataFrame, width: float, query: list) -> DataFrame:
    """Of each query's occupied cells, those that may hold the nearest object: none lies beyond the farthest corner of the best one."""
    w = width * _scale(F.col("level"))
    sides = lambda p, c: (F.col(c) * w - F.col(p), F.col(p) - (F.col(c) + 1) * w)
    (l, r), (b, a) = sides("x", "cx"), sides("y", "cy")
    outside = lambda u, v: F.greatest(u, v, F.lit(0.0))
    least, most = _distance(outside(l, r), outside(b, a)), _distance(F.greatest(-l, -r), F.greatest(-b, -a))
    best = F.min(most).over(Window.partitionBy(*query))
    return cells.withColumn("_least", least).withColumn("_best", best).where(F.col("_least") * (1 - 1e-9) <= F.col("_best") * (1 + 1e-9)).drop("_least", "_best")  # edges are rounded


def _levels(q: DataFrame, t: DataFrame) -> int | None:
    """Levels until one cell and its neighbours hold all queries and all objects; None without either."""
    a, b = (df.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first() for df in (q, t))
    if a[0] is None or b[0] is None:
        return None
    levels, extent = 1, max(max(a[1], b[1]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[2], b[2])) + 1
    while GROW**levels < extent:
        levels += 1
    return levels


def interior(distances: DataFrame, clearance: str, buffer: float) -> DataFrame:
    """Distances that the edge of the support cannot have changed."""
    return distances.where((F.col(clearance) >= buffer) & (F.col("distance") <= F.col(clearance)))


def with_clearance(distances: DataFrame, clearances: DataFrame, frame: DataFrame, width: float, keys=("job",)) -> DataFrame:
    """Rows (``x``, ``y``) with the clearance of their cell, those beyond the edge taking the outermost cell's.

    ``clearances``: ``(keys, ix, iy, clearance)`` of supported cells; elsewhere the
    clearance is that of a cell outside, less than 0.
    """
    rows = distances.join(F.broadcast(frame), list(keys))  # one row per section
    for c in ("x", "y"):
        rows = rows.withColumn(f"i{c}", F.greatest(F.lit(0), F.least(bin_index(c, F.col(f"{c}0"), width), F.col(f"n{c}") - 1)))
    out = rows.join(clearances.select(*keys, "ix", "iy", "clearance"), [*keys, "ix", "iy"], "left")
    return out.withColumn("clearance", F.coalesce("clearance", F.lit(-width * 2**0.5 / 2))).drop("x0", "y0", "nx", "ny")


def proximity_summary(distances: DataFrame, buffer: float, keys=("job",)) -> DataFrame:
    """Per group: rows, those whose distance the edge cannot have changed, and exact medians of both, in two readings; ``distances`` has ``clearance``.

    A group with an unknown key is left out.
    """
    from .distribution import selected

    inner = (F.col("clearance") >= buffer) & (F.col("distance") <= F.col("clearance"))
    rows = distances.withColumn("_inner", F.when(inner, F.col("distance")))
    counts = (F.count("*").alias("n"), F.count("_inner").alias("n_interior"))
    wanted = {"median_all": ("distance", 0.5), "q95_all": ("distance", 0.95), "median_interior": ("_inner", 0.5)}
    return selected(rows, wanted, {}, keys, counts).withColumn("retained_pct", 100.0 * F.col("n_interior") / F.col("n"))
