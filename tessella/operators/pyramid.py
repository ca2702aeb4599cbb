"""Grids of several widths from one reading of the objects, and the payload of sections that a viewer opens.

Cells are counted at the finest widths; a width that is a whole multiple of a
finer one is rolled up from that one's cells, since cells of the ``closed``
convention nest: their origins are multiples of their widths.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import MAX_CELLS, check_parameters

#: Layers of every grid, and those that a fine grid goes without.
BASIC = ("n_a", "n_b", "n_positive")
MORE = ("n_all", "area_a", "n_large", "overlap_area")
LARGE = 1.0


def roots(widths) -> dict:
    """width -> the finest of ``widths`` that it is a whole multiple of (itself, if none)."""
    out: dict = {}
    for width in sorted(map(float, widths)):
        check_parameters(width)
        out[width] = next((r for r in sorted(set(out.values())) if round(width / r) * r == width), width)
    return out


def _layers() -> dict:
    a, total = F.col("object_type") == "A", lambda c: F.coalesce(F.sum(F.when(F.col("object_type") == "A", F.col(c))), F.lit(0.0))
    return {"n_a": F.count_if(a), "n_b": F.count_if(~a), "n_positive": F.count_if(a & F.col("b_present")), "n_all": F.count("*"), "area_a": total("area"), "n_large": F.count_if(a & (F.col("area") >= LARGE)), "overlap_area": total("overlap_area")}


def grid_pyramid(objects: DataFrame, widths, keys=("job",)) -> DataFrame:
    """``(keys, width, ix, iy, x0, y0, nx, ny, layers)``: occupied cells of every width, ``closed`` convention.

    The objects are read once: they are counted in cells of the finest widths at
    places that need no frame; frames and coarser cells come from those.
    Objects without a place take no part.
    """
    root, layers, keys = roots(widths), _layers(), list(keys)
    finest = sorted(set(root.values()))
    placed = objects.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(*keys, "x", "y", "object_type", "b_present", "area", "overlap_area", F.explode(F.array(*map(F.lit, finest))).alias("_root"))
    at = lambda c: F.floor(F.col(c) / F.col("_root")).alias(f"_k{c}")
    bounds = [f(c).alias(f"_{c}{side}") for c in ("x", "y") for f, side in ((F.min, "lo"), (F.max, "hi"))]
    fine = placed.groupBy(*keys, "_root", at("x"), at("y")).agg(*(e.alias(n) for n, e in layers.items()), *bounds)
    ladder = F.array(*(F.when(F.col("_root") == r, F.struct(F.lit(w).alias("width"), F.lit(round(w / r)).alias("m"))) for w, r in root.items()))
    levels = fine.select("*", F.explode(F.filter(ladder, lambda s: s.isNotNull())).alias("_s")).withColumn("width", F.col("_s.width"))
    for c in ("x", "y"):
        levels = levels.withColumn(f"_k{c}", F.floor(F.col(f"_k{c}") / F.col("_s.m")))
    section = Window.partitionBy(*keys, "width")  # its occupied cells, already counted
    for c in ("x", "y"):
        low, high = F.min(f"_{c}lo").over(section), F.max(f"_{c}hi").over(section)
        levels = levels.withColumn(f"_o{c}", F.floor(low / F.col("width"))).withColumn(f"n{c}", F.greatest(F.ceil(high / F.col("width")) - F.col(f"_o{c}"), F.lit(1)))
    inside = lambda c: F.least(F.col(f"_k{c}") - F.col(f"_o{c}"), F.col(f"n{c}") - 1).alias(f"i{c}")
    origin = lambda c: (F.col(f"_o{c}") * F.col("width")).alias(f"{c}0")
    return levels.groupBy(*keys, "width", inside("x"), inside("y"), origin("x"), origin("y"), "nx", "ny").agg(*(F.sum(n).alias(n) for n in layers))


def section_payload(objects: DataFrame, metadata: DataFrame, widths, fine: float, reviews: DataFrame | None = None, job: str = "job") -> DataFrame:
    """``(job, json)``: one strict JSON value per section, with its identity and dense grids of all widths.

    ``metadata``: one row per section; all its columns are written, those of
    ``reviews`` (``job, ready, center, polygon, orientation``) only where the
    section is ``ready``, and null elsewhere.  The grid of width ``fine`` has
    the BASIC layers, all others MORE as well, as arrays of rows; ``x`` and ``y``
    are the centres of columns and rows.  A grid of more than the cap of cells,
    a section without objects, and a negative or infinite layer are errors when
    the payload is computed.
    """
    layers = [*BASIC, *MORE]
    cells = grid_pyramid(objects, [fine, *widths], (job,))
    bad = F.greatest(*(F.coalesce((F.col(c) < 0) | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(True)) for c in layers))
    cells = cells.withColumn("n_all", F.when(bad, F.raise_error(F.lit("layers must be known, finite and not negative"))).otherwise(F.col("n_all")))
    cells = cells.withColumn("ny", F.when(F.col("nx") * F.col("ny") > MAX_CELLS, F.raise_error(F.concat((F.col("nx") * F.col("ny")).cast("string"), F.lit(f" cells: more than {MAX_CELLS}")))).otherwise(F.col("ny")))
    # One occupied cell of each grid stands for all its cells, so that nothing is read or joined again for the empty ones.
    first = F.row_number().over(Window.partitionBy(job, "width").orderBy("iy", "ix")) == 1
    dense = cells.withColumn("_first", first)
    for c in ("y", "x"):
        every = F.sequence(F.lit(0).cast("long"), F.col(f"n{c}") - 1)
        dense = dense.withColumn(f"_{c}", F.explode(F.when(F.col("_first"), every).otherwise(F.array(f"i{c}"))))
    own = (F.col("_x") == F.col("ix")) & (F.col("_y") == F.col("iy"))
    dense = dense.groupBy(job, "width", "x0", "y0", "nx", "ny", F.col("_y").alias("iy"), F.col("_x").alias("ix")).agg(*(F.sum(F.when(own, F.col(c)).otherwise(F.lit(0))).alias(c) for c in layers))
    frame = ["x0", "y0", "nx", "ny"]
    across = dense.groupBy(job, "width", *frame, "iy").agg(F.sort_array(F.collect_list(F.struct("ix", *layers))).alias("_row"))
    grids = across.groupBy(job, "width", *frame).agg(F.sort_array(F.collect_list(F.struct("iy", "_row"))).alias("_rows"))
    centres = lambda c: F.transform(F.sequence(F.lit(0), F.col(f"n{c}") - 1), lambda i: F.col(f"{c}0") + (i + 0.5) * F.col("width")).alias(c)
    matrix = lambda n: F.transform("_rows", lambda r: F.transform(r["_row"], lambda v: v[n])).alias(n)
    one = lambda names: F.struct(centres("x"), centres("y"), "width", *map(matrix, names))
    of = lambda w, names: F.max(F.when(F.col("width") == w, one(names)))
    named = lambda w: f"{w:g}"
    both = grids.groupBy(job).agg(of(float(fine), BASIC).alias("fine"), F.struct(*(of(float(w), layers).alias(named(w)) for w in widths)).alias("grids"))
    known = metadata
    if reviews is not None:
        shown = [F.when(F.coalesce("ready", F.lit(False)), F.col(c)).alias(f"reviewed_{c}") for c in ("center", "polygon", "orientation")]
        known = metadata.join(reviews.select(job, F.coalesce("ready", F.lit(False)).alias("ready"), *shown), job, "left").withColumn("ready", F.coalesce("ready", F.lit(False)))
    rows = known.join(both, job, "left")
    rows = rows.withColumn("fine", F.when(F.col("fine").isNull(), F.raise_error(F.concat(F.lit("sections without objects: "), F.col(job).cast("string")))).otherwise(F.col("fine")))
    return rows.select(job, F.to_json(F.struct(*known.columns, "fine", "grids"), {"ignoreNullFields": "false"}).alias("json"))
