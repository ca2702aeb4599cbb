"""Two-dimensional binning in long form ``(keys, ix, iy, counts)``.

Four conventions for the edges, which differ on purpose:

* ``zero``   - from the multiple of the width at or below the least value, one
  full bin past the greatest: no point can lie on the last edge;
* ``closed`` - up to the multiple at or above the greatest value, at least one
  bin; a point on the top edge lies in the last bin;
* ``padded`` - as ``closed`` with ``pad`` more bins on each side; an extent of
  width zero on a multiple has no bin;
* ``points`` - from the points' own minimum, half-open, up to the greatest index.

A cell without objects is a count of 0 with an *unknown* rate; a supported cell
without hits is a real 0.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bin_closed, bin_index, percent, ratio

MAX_CELLS = 2_000_000
CONVENTIONS = ("zero", "closed", "padded", "points")


def check_parameters(width: float, support: int = 1, sigma: float = 0.0) -> None:
    """Fail before any plan is built."""
    if not (isinstance(width, (int, float)) and math.isfinite(width) and width > 0):
        raise ValueError("width must be finite and positive")
    if not isinstance(support, int) or isinstance(support, bool) or support < 1:
        raise ValueError("support must be an integer of at least 1")
    if not (math.isfinite(sigma) and sigma >= 0):
        raise ValueError("sigma must be finite and not negative")


def frames(objects: DataFrame, width: float, convention: str = "closed", keys=("job",), pad: int = 0) -> DataFrame:
    """Origin and number of bins of each group, from its extents: one small row per group."""
    if convention not in CONVENTIONS:
        raise ValueError(f"convention must be one of {CONVENTIONS}")
    ext = objects.groupBy(*keys).agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi"))
    out = ext
    for c in ("x", "y"):
        lo, hi = F.floor(F.col(f"{c}_lo") / width), F.col(f"{c}_hi") / width
        if convention in ("zero", "points"):
            n = F.floor(hi) - lo + 1
        elif convention == "closed":
            n = F.greatest(F.ceil(hi) - lo, F.lit(1))
        else:
            lo, n = lo - pad, F.ceil(hi) - lo + 2 * pad
        out = out.withColumn(f"{c}0", lo * float(width)).withColumn(f"n{c}", n.cast("long"))
    return out.drop("x_lo", "x_hi", "y_lo", "y_hi")


def check_size(frame: DataFrame) -> None:
    """Raise if a grid has more than MAX_CELLS cells."""
    if (worst := frame.agg(F.max(F.col("nx") * F.col("ny"))).first()[0] or 0) > MAX_CELLS:
        raise ValueError(f"{worst} cells: more than {MAX_CELLS}")


def place(objects: DataFrame, frame: DataFrame, width: float, convention: str = "closed", keys=("job",)) -> DataFrame:
    """``objects`` with ``ix`` and ``iy``; frames have one row per group and are joined by broadcast below Spark's limit."""
    rows = objects.join(frame, list(keys))
    for c in ("x", "y"):
        at = bin_closed(c, F.col(f"{c}0"), width, f"n{c}") if convention in ("closed", "padded") else bin_index(c, F.col(f"{c}0"), width)
        rows = rows.withColumn(f"i{c}", at)
    return rows.drop("x0", "y0", "nx", "ny")


def spine(frame: DataFrame, keys=("job",)) -> DataFrame:
    """Every cell of every grid."""
    cells = frame.where("nx > 0 and ny > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("ix"), "ny")
    return cells.select(*keys, "ix", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("iy"))


def cells(objects: DataFrame, width: float, aggregates: dict, convention: str = "closed", keys=("job",), dense: bool = True, frame: DataFrame | None = None) -> DataFrame:
    """One conditional aggregate per cell; with ``dense``, empty cells are 0."""
    check_parameters(width)
    frame = frames(objects, width, convention, keys) if frame is None else frame
    counts = place(objects, frame, width, convention, keys).groupBy(*keys, "ix", "iy").agg(*(a.alias(n) for n, a in aggregates.items()))
    if not dense:
        return counts
    check_size(frame)
    return spine(frame, keys).join(counts, [*keys, "ix", "iy"], "left").na.fill(0, list(aggregates))


def basic_layers() -> dict:
    """Counts and sums of both classes."""
    a = F.col("object_type") == "A"
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0.0))
    return {"n_a": F.count_if(a), "n_b": F.count_if(~a), "positive": F.count_if(a & F.col("b_present")), "overlap_pct_sum": total(a, "overlap_pct")}


def fraction_grid(objects: DataFrame, width: float, support: int = 10, convention: str = "zero", keys=("job",)) -> DataFrame:
    """Counts, raw fraction (known where there is an object) and displayed fraction (known where support is met)."""
    check_parameters(width, support)
    g = cells(objects, width, basic_layers(), convention, keys)
    g = g.withColumn("fraction_pct", percent("positive", "n_a")).withColumn("mean_overlap_pct", ratio("overlap_pct_sum", "n_a"))
    return g.withColumn("supported", F.col("n_a") >= support).withColumn("display_pct", F.when(F.col("supported"), F.col("fraction_pct")))


def analysis_grid(objects: DataFrame, width: float, support: int = 10, keys=("job",)) -> DataFrame:
    """All layers of the analysis in one pass."""
    a, b = F.col("object_type") == "A", F.col("object_type") == "B"
    pos, area = F.col("b_present"), F.col("area")
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    layers = {
        "n_all": F.count("*"), "n_a": F.count_if(a), "n_b": F.count_if(b), "positive": F.count_if(a & pos), "negative": F.count_if(a & ~pos), "large": F.count_if(a & (area >= 1)), "small": F.count_if(a & (area < 0.1)),
        "area_a": total(a, area), "positive_area": total(a & pos, area), "overlap_area": total(a, F.col("overlap_area")),
    }
    g = cells(objects, width, layers, "closed", keys)
    ok, small_ok = F.col("n_a") >= support, F.col("small") >= support
    return g.select(
        "*",
        F.when(ok, percent("positive", "n_a")).alias("association_pct"),
        F.when(ok, percent("overlap_area", "area_a")).alias("area_overlap_pct"),
        F.when(small_ok, ratio("large", "small")).alias("large_small_ratio"),
        ok.alias("supported"),
    )


def paired_grid(objects: DataFrame, width: float, run: str, runs, keys=("pair", "object_type"), frame_keys=("pair",)) -> DataFrame:
    """Counts of two runs on edges common to both, and their difference."""
    frame = frames(objects, width, "zero", frame_keys)
    check_size(frame)
    a, b = (F.count_if(F.col(run) == r) for r in runs)
    counts = place(objects, frame, width, "zero", frame_keys).groupBy(*keys, "ix", "iy").agg(a.alias("n_first"), b.alias("n_second"))
    extra = [k for k in keys if k not in frame_keys]
    every = spine(frame, frame_keys).join(objects.select(*keys).distinct(), list(frame_keys)) if extra else spine(frame, frame_keys)
    g = every.join(counts, [*keys, "ix", "iy"], "left").na.fill(0, ["n_first", "n_second"])
    return g.withColumn("delta", F.col("n_second") - F.col("n_first"))


def aligned_rerun(short: DataFrame, full: DataFrame, width: float, keys=("pair",)) -> DataFrame:
    """Both runs on the full run's frame; a point of the short run outside it is an error."""
    frame = frames(full, width, "closed", keys)
    checked = short.join(frame, list(keys))
    outside = ~(F.col("x").between(F.col("x0"), F.col("x0") + F.col("nx") * width) & F.col("y").between(F.col("y0"), F.col("y0") + F.col("ny") * width))
    if n := checked.where(outside).count():
        raise ValueError(f"{n} points outside the frame of the full run")
    both = short.select(*keys, "x", "y", F.lit(0).alias("full")).unionByName(full.select(*keys, "x", "y", F.lit(1).alias("full")))
    return cells(both, width, {"n_short": F.count_if(F.col("full") == 0), "n_full": F.count_if(F.col("full") == 1)}, "closed", keys, frame=frame)


def smoothed_fraction(grid: DataFrame, sigma: float, support: int = 10, keys=("job",), truncate: float = 4.0) -> DataFrame:
    """Gaussian-smoothed positives over smoothed counts, shown where the raw support is met.

    ``grid`` is dense.  Weights run to ``truncate * sigma`` in each direction;
    cells beyond the edge take no part in either sum, so a constant stays itself.
    The kernel is a product, so it is applied along x, then along y: a cell is
    copied ``2 r + 1`` times in each pass.
    """
    check_parameters(1.0, support, sigma)
    r = int(truncate * sigma + 0.5)
    near = F.array(*(F.struct(F.lit(i).cast("long").alias("d"), F.lit(math.exp(-(i * i) / (2 * sigma * sigma)) if sigma else 1.0).alias("w")) for i in range(-r, r + 1)))
    sums = grid.where("n_a > 0").select(*keys, "ix", "iy", F.col("n_a").cast("double").alias("n"), F.col("positive").cast("double").alias("k"))
    for c in ("ix", "iy"):
        moved = sums.withColumn("_o", F.explode(near)).withColumn(c, F.col(c) + F.col("_o.d"))
        sums = moved.groupBy(*keys, "ix", "iy").agg(*(F.sum(F.col(v) * F.col("_o.w")).alias(v) for v in ("n", "k")))
    out = grid.select(*keys, "ix", "iy", "n_a").join(sums, [*keys, "ix", "iy"], "left")
    return out.select(*keys, "ix", "iy", "n_a", F.when(F.col("n_a") >= support, percent("k", "n")).alias("smoothed_pct"))


def support_sensitivity(objects: DataFrame, widths, thresholds, keys=("job",)) -> DataFrame:
    """Cells occupied and supported, and objects in supported cells, for each width and threshold.

    The objects are read once: a row stands for each width, and the cells of all
    widths are counted together.
    """
    a = objects.where("object_type = 'A'")
    frame = None
    for width in widths:
        check_parameters(width)
        one = frames(a, width, "closed", keys).withColumn("width", F.lit(float(width)))
        frame = one if frame is None else frame.unionByName(one)
    rows = a.select(*keys, "x", "y").withColumn("width", F.explode(F.array(*(F.lit(float(w)) for w in widths)))).join(frame, [*keys, "width"])
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("width")).cast("long"), F.col(f"n{c}") - 1)
    g = rows.groupBy(*keys, "width", at("x").alias("ix"), at("y").alias("iy")).agg(F.count("*").alias("n"))
    g = g.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    enough = F.col("n") >= F.col("threshold")
    out = g.groupBy(*keys, "threshold", "width").agg(F.count("*").alias("occupied"), F.count_if(enough).alias("supported"), F.coalesce(F.sum(F.when(enough, F.col("n"))), F.lit(0)).alias("objects_supported"), F.sum("n").alias("objects"))
    return out.select(*keys, "threshold", "occupied", "supported", "objects_supported", "objects", "width", percent("objects_supported", "objects").alias("objects_pct"))


def count_scales(grid: DataFrame, counts=("n_a", "n_b")) -> DataFrame:
    """Greatest count over all groups, for shared scales."""
    return grid.agg(*(F.max(c).alias(f"max_{c}") for c in counts))


def size_overlap_histogram(objects: DataFrame, area_bins: int = 36, overlap_bins: int = 25, keys=("job",)) -> DataFrame:
    """Objects of class A by logarithmic area and overlap; common edges, all cells kept."""
    a = objects.where("object_type = 'A' and area > 0")
    lo, hi, first = a.agg(F.min("area"), F.max("area"), F.min(F.log("area"))).first()
    if lo is None:
        return a.select(*keys, F.lit(0).alias("ia"), F.lit(0).alias("io"), F.lit(0).cast("long").alias("n")).limit(0)
    step = (math.log(hi * (1 + 1e-10)) - first) / area_bins or 1.0
    ia = F.least(F.floor((F.log("area") - first) / step), F.lit(area_bins - 1)).cast("long")
    io = F.least(F.floor(F.col("overlap_pct") / (100.0 / overlap_bins)), F.lit(overlap_bins - 1)).cast("long")
    counts = a.groupBy(*keys, ia.alias("ia"), io.alias("io")).agg(F.count("*").alias("n"))
    every = a.select(*keys).distinct().crossJoin(F.broadcast(a.sparkSession.range(area_bins * overlap_bins))).select(*keys, F.expr(f"id div {overlap_bins}").alias("ia"), (F.col("id") % overlap_bins).alias("io"))
    return every.join(counts, [*keys, "ia", "io"], "left").na.fill(0, ["n"])


def equal_maps(grid: DataFrame, value: str, keys=("arm", "grp"), minimum: int = 3) -> DataFrame:
    """Mean over replicates of what is known in a cell, where at least ``minimum`` know it."""
    g = grid.groupBy(*keys, "ix", "iy").agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return g.select(*keys, "ix", "iy", "n", F.when(F.col("n") >= minimum, F.col("m")).alias("mean"))


def map_difference(maps: DataFrame, keys=("arm",)) -> DataFrame:
    """Treated minus control, where both are known."""
    pick = lambda g: F.max(F.when(F.col("grp") == g, F.col("mean")))
    return maps.groupBy(*keys, "ix", "iy").agg((pick("treated") - pick("control")).alias("difference"))


def registered_maps(objects: DataFrame, width: float, support: int = 10, half: float = 30_000.0, keys=("arm", "grp"), job: str = "job") -> DataFrame:
    """Fraction maps of transformed coordinates ``tx``, ``ty`` on one fixed frame, averaged over sections with support."""
    inside = objects.where(f"object_type = 'A' and tx >= {-half} and tx <= {half} and ty >= {-half} and ty <= {half}")
    n = math.ceil(2 * half / width)
    binned = inside.withColumn("ix", bin_closed("tx", -half, width, F.lit(n))).withColumn("iy", bin_closed("ty", -half, width, F.lit(n)))
    per = binned.groupBy(*keys, job, "ix", "iy").agg(F.count("*").alias("n"), F.count_if("b_present").alias("k"))
    return equal_maps(per.withColumn("fraction", F.when(F.col("n") >= support, percent("k", "n"))), "fraction", keys)


def coverage(objects: DataFrame, width: float, keys=("arm", "grp"), job: str = "job") -> DataFrame:
    """How many sections have an object in each transformed cell."""
    binned = objects.select(*keys, job, bin_index("tx", F.lit(0.0), width).alias("ix"), bin_index("ty", F.lit(0.0), width).alias("iy"))
    return binned.groupBy(*keys, "ix", "iy").agg(F.countDistinct(job).alias("n_sections"))


def argmax_cells(grid: DataFrame, value: str, keys=("job",)) -> DataFrame:
    """The cell of greatest value per group, the first in row order (iy, then ix) of equals; unknown values take no part."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), "iy", "ix")
    return grid.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def hotspot(objects: DataFrame, width: float = 1000.0, window: float = 150.0, keys=("job",)) -> DataFrame:
    """Objects whose boxes meet a window about the object of class A nearest to the centre of the fullest cell."""
    a = objects.where("object_type = 'A'")
    frame = frames(a, width, "zero", keys)
    top = argmax_cells(place(a, frame, width, "zero", keys).groupBy(*keys, "ix", "iy").agg(F.count("*").alias("n")), "n", keys)
    centre = top.join(frame, list(keys)).select(*keys, (F.col("x0") + (F.col("ix") + 0.5) * width).alias("cx"), (F.col("y0") + (F.col("iy") + 0.5) * width).alias("cy"))
    d = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    focus = a.join(centre, list(keys)).groupBy(*keys).agg(F.min(F.struct(d.alias("d"), "object_id", "x", "y")).alias("f")).select(*keys, F.col("f.x").alias("fx"), F.col("f.y").alias("fy"))
    h = window / 2
    meets = (F.col("xmax") >= F.col("fx") - h) & (F.col("xmin") <= F.col("fx") + h) & (F.col("ymax") >= F.col("fy") - h) & (F.col("ymin") <= F.col("fy") + h)
    return objects.join(focus, list(keys)).where(meets)


def share_grid(objects: DataFrame, cluster: str, clusters, width: float, support: int = 10, keys=("job",)) -> DataFrame:
    """Cluster shares of valid objects per cell of the points' own frame, known where supported."""
    frame = frames(objects, width, "points", keys)
    valid = F.col(cluster).isNotNull()
    g = place(objects, frame, width, "points", keys).groupBy(*keys, "ix", "iy").agg(F.count("*").alias("n_all"), F.count_if(valid).alias("n"), F.count_if(~valid).alias("n_excluded"), *(F.count_if(F.col(cluster) == c).alias(f"k{c}") for c in clusters))
    return g.select(*keys, "ix", "iy", "n_all", "n", "n_excluded", *(F.when(F.col("n") >= support, percent(f"k{c}", "n")).alias(f"pct_{c}") for c in clusters))


def shown_cells(grid: DataFrame, value: str, support: int | None = None, support_column: str = "n_a", log: bool = False, reverse: bool = False) -> DataFrame:
    """Cells as a viewer shows them: ``shown`` is the value where the support is met, as log(1 + count) or with its sign reversed on demand."""
    v = F.col(value).cast("double")
    v = F.log1p(v) if log else v
    v = -v if reverse else v
    return grid.withColumn("shown", v if support is None else F.when(F.col(support_column) >= support, v))


def points_in_window(objects: DataFrame, x_lo: float, x_hi: float, y_lo: float, y_hi: float) -> DataFrame:
    """Objects whose midpoint lies in a window, its edges included."""
    return objects.where(F.col("x").between(x_lo, x_hi) & F.col("y").between(y_lo, y_hi))


def supported_share(grid: DataFrame, keys=("job",)) -> DataFrame:
    """How many occupied cells are supported, and the percentage of them."""
    g = grid.where("n_a > 0").groupBy(*keys).agg(F.count("*").alias("occupied"), F.count_if("supported").alias("supported"))
    return g.withColumn("supported_pct", percent("supported", "occupied"))


def check_conserved(grid: DataFrame, objects: DataFrame, count: str = "n_all") -> None:
    """Raise unless the cells hold every object once."""
    if (grid.agg(F.sum(count)).first()[0] or 0) != objects.count():
        raise ValueError("cells do not hold all objects")


