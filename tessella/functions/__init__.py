"""Column expressions with one missing-value rule.

Non-finite numbers are unknown (NULL) from the start.  A *complete* mean or sum
is unknown as soon as one value is; an empty mean is unknown, an empty sum 0.
A ratio is unknown unless its denominator is positive.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def complete_mean(c) -> Column:
    c = col(c)
    return F.when((F.count("*") > 0) & (F.count("*") == F.count(c)), F.avg(c))


def complete_sum(c) -> Column:
    c = col(c)
    return F.when(F.count("*") == F.count(c), F.coalesce(F.sum(c), F.lit(0.0)))


def percent(num, den) -> Column:
    """``100 * num / den`` where ``den > 0``."""
    return F.when(col(den) > 0, 100.0 * col(num) / col(den))


def ratio(num, den) -> Column:
    return F.when(col(den) > 0, col(num) / col(den))


def flag(c) -> Column:
    """A condition as 1.0 or 0.0; unknown stays unknown."""
    return col(c).cast("int").cast("double")


def midpoint(lo, hi) -> Column:
    return (col(lo) + col(hi)) / 2


def stratum(c, edges) -> Column:
    """Number (from 0) of the half-open interval ``[edges[i], edges[i + 1])``; the last is unbounded; NULL below the first."""
    c, out = col(c), None
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(c >= edges[i], F.lit(i)) if out is None else out.when(c >= edges[i], F.lit(i))
    return out


def stratum_label(i: int, edges) -> str:
    return f"[{edges[i]:g},{edges[i + 1]:g})" if i + 1 < len(edges) else f"[{edges[i]:g},inf)"


def bin_index(c, origin, width: float) -> Column:
    """Half-open bins: ``floor((c - origin) / width)``."""
    return F.floor((col(c) - origin) / width).cast("long")


def bin_closed(c, origin, width: float, bins) -> Column:
    """As :func:`bin_index`, but a point on the top edge lies in the last bin."""
    return F.least(bin_index(c, origin, width), col(bins) - 1)


def aligned_low(c, width: float) -> Column:
    """The multiple of ``width`` at or below the value."""
    return F.floor(col(c) / width) * width


#: Sign of x and y under each discrete orientation.
FLIPS = {"none": (1, 1), "x": (-1, 1), "y": (1, -1), "both": (-1, -1)}


def flipped(x, y, center_x, center_y, orientation) -> tuple:
    """Coordinates about a centre, mirrored as the orientation says; an unknown orientation gives NULL."""
    sx = sy = None
    for name, (a, b) in FLIPS.items():
        hit = col(orientation) == name
        sx = F.when(hit, a) if sx is None else sx.when(hit, a)
        sy = F.when(hit, b) if sy is None else sy.when(hit, b)
    return sx * (col(x) - col(center_x)), sy * (col(y) - col(center_y))


def reasons(**conditions) -> Column:
    """Names of the conditions that hold, in the order given, parted by ``'; '``."""
    return F.concat_ws("; ", *(F.when(c, F.lit(name.replace("_", " "))) for name, c in conditions.items()))


def first_where(value, *order):
    """Aggregate: the value of the row that is least by ``order``; ties must be broken by it."""
    return F.min_by(col(value), F.struct(*map(col, order)))


def polygon_sums(polygon) -> Column:
    """``struct(a, cx, cy)`` of the shoelace sums over an array of ``struct<x,y>``."""
    p = col(polygon)
    nxt = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    edges = F.zip_with(p, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    add = lambda f: F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + f(e))
    return F.struct(
        add(cross).alias("a"),
        add(lambda e: (e["a"]["x"] + e["b"]["x"]) * cross(e)).alias("cx"),
        add(lambda e: (e["a"]["y"] + e["b"]["y"]) * cross(e)).alias("cy"),
    )


def polygon_contains(polygon, x, y) -> Column:
    """Even-odd ray casting."""
    p = col(polygon)
    nxt = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    edges = F.zip_with(p, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(F.coalesce(crosses(e), F.lit(False)), 1).otherwise(0)) % 2 == 1


def polygon_centroid(polygon) -> Column:
    """``struct<x,y>``; NULL for fewer than three vertices, unknown ones, a degenerate area, or a centroid outside."""
    p, s = col(polygon), polygon_sums(polygon)
    good = (F.size(p) >= 3) & ~F.exists(p, lambda v: v["x"].isNull() | v["y"].isNull() | F.isnan(v["x"]) | F.isnan(v["y"]) | (F.abs(v["x"]) == float("inf")) | (F.abs(v["y"]) == float("inf"))) & (F.abs(s["a"]) >= 1e-10)
    x, y = s["cx"] / (3 * s["a"]), s["cy"] / (3 * s["a"])
    return F.when(good, F.when(polygon_contains(p, x, y), F.struct(x.alias("x"), y.alias("y"))))
