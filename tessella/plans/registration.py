"""Group maps behind the review gate: whether a plan for them is built at all is decided from the review records."""

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import FLIPS, bin_closed, flipped, percent, polygon_centroid
from ..operators.grid import MAX_CELLS, check_parameters
from .design import Design, fetched, review_status

#: The frame of registered maps runs from -HALF to HALF in both directions.
HALF = 30_000.0


@dataclass(frozen=True)
class Registration:
    """What the gate says, and the maps; ``maps`` is None unless it is ``ready``.

    ``needs_review``: ``(job, reasons)`` of the sections that are not approved.
    """

    ready: bool
    approved: int
    total: int
    message: str
    needs_review: tuple
    maps: DataFrame | None = None

    def status(self, spark) -> DataFrame:
        """One row: ``(ready, approved, total, message)``."""
        return spark.createDataFrame([(self.ready, self.approved, self.total, self.message)], "ready boolean, approved int, total int, message string")


def _identity_fault(rows: list, sections: set, design: Design) -> str:
    """What is wrong with the identities of as many records as the design asks for; empty if nothing is."""
    jobs, replicates = {str(r["job"]) for r in rows}, {r["replicate"] for r in rows}
    known = design.assignment or {r["replicate"]: r["grp"] for r in rows}
    if len(jobs) != len(rows):
        return "a section has several records"
    if {(r["replicate"], r["arm"]) for r in rows} != {(a, arm) for a in (design.assignment or replicates) for arm in design.arms}:
        return "records are not every replicate in every arm"
    if any(known.get(r["replicate"]) != r["grp"] for r in rows) or Counter(known.values()) != Counter({g: design.per_group for g in design.groups}):
        return "groups differ from the recorded assignment"
    if jobs != sections:
        return "records and objects name different sections"
    return ""


def condition_registration(objects: DataFrame, records: DataFrame, design: Design, width: float = 1000.0, support: int = 10) -> Registration:
    """Control minus treated maps of reviewed sections, or why there are none.

    ``records``: one per section, with the design's columns and those of
    :func:`review_status`.  Maps are withheld unless there are exactly the
    design's records, every replicate in every arm, each in its recorded group,
    of the same sections as the objects, all approved; only then are parameters
    checked and coordinates computed.  A reviewed polygon without a centroid
    inside, an orientation other than the four flips, and an object of class A
    outside the frame are errors.

    Maps have every cell of the frame once per arm: ``(arm, ix, iy, control_n,
    treated_n, control_mean, treated_mean, difference)``.  A replicate counts in
    a cell where it has ``support`` objects; a mean needs all of the group's
    replicates, and what is not known is null, never 0.
    """
    status = {r["job"]: r for r in fetched(review_status(records), "review records")}
    named = records.select("job", F.col(design.replicate).alias("replicate"), F.col(design.group).alias("grp"), F.col(design.arm).alias("arm"), "orientation", F.col("reviewed_polygon").isNotNull().alias("traced"), polygon_centroid("reviewed_polygon").alias("c"))
    rows = fetched(named, "review records")
    if bad := sorted({r["job"] for r in rows if r["traced"] and r["c"] is None}):
        raise ValueError(f"reviewed polygons without a centroid inside: {bad}")
    if bad := sorted({r["job"] for r in rows if (r["orientation"] or "none") not in FLIPS}):
        raise ValueError(f"only discrete flips are permitted: {bad}")
    expected, total = 2 * design.per_group * len(design.arms), len(rows)
    approved = sum(status[r["job"]]["ready"] for r in rows)
    waiting = tuple((j, s["reasons"]) for j, s in sorted(status.items()) if not s["ready"])
    withheld = lambda why: Registration(False, approved, total, f"group maps withheld: {why}", waiting)
    if total != expected:
        return withheld(f"{total} of {expected} section reviews")
    sections = {str(r["job"]) for r in fetched(objects.select(F.col(design.section).alias("job")).distinct())}
    if fault := _identity_fault(rows, sections, design):
        return withheld(fault)
    if approved != expected:
        return withheld(f"{approved} of {expected} sections are approved")

    check_parameters(width, support)
    n = math.floor(2 * HALF / width)
    if n < 1 or n * n > MAX_CELLS:
        raise ValueError(f"{n * n} cells: from 1 to {MAX_CELLS} are possible")
    spark = objects.sparkSession
    centre = spark.createDataFrame([(r["job"], float(r["c"]["x"]), float(r["c"]["y"]), r["orientation"] or "none", r["arm"], r["grp"]) for r in rows], f"_job {dict(records.dtypes)['job']}, _cx double, _cy double, _o string, arm string, grp string")
    a = objects.where("object_type = 'A'").select(F.col(design.section).alias("_job"), "x", "y", "b_present").join(F.broadcast(centre), "_job")  # a row per section
    tx, ty = flipped("x", "y", "_cx", "_cy", "_o")
    a = a.withColumn("tx", tx).withColumn("ty", ty)
    top = n * width - HALF
    if outside := a.where(~(F.col("tx").between(-HALF, top) & F.col("ty").between(-HALF, top))).count():
        raise ValueError(f"{outside} objects of class A lie outside the registered frame")
    at = lambda c: bin_closed(c, -HALF, width, F.lit(n))
    per = a.groupBy("arm", "grp", "_job", at("tx").alias("ix"), at("ty").alias("iy")).agg(F.when(F.count("*") >= support, percent(F.count_if("b_present"), F.count("*"))).alias("_m"))
    control, treated = design.groups
    side = lambda f, g: f(F.when(F.col("grp") == g, F.col("_m")))
    found = per.groupBy("arm", "ix", "iy").agg(
        *(side(F.count, g).alias(f"{name}_n") for name, g in (("control", control), ("treated", treated))),
        *(F.when(side(F.count, g) == design.per_group, side(F.avg, g)).alias(f"{name}_mean") for name, g in (("control", control), ("treated", treated))),
    )
    every = spark.range(n * n).select((F.col("id") % n).alias("ix"), F.expr(f"id div {n}").alias("iy"), F.explode(F.array(*map(F.lit, design.arms))).alias("arm"))
    maps = every.join(found, ["arm", "ix", "iy"], "left").na.fill(0, ["control_n", "treated_n"])
    maps = maps.select("arm", "ix", "iy", "control_n", "treated_n", "control_mean", "treated_mean", (F.col("control_mean") - F.col("treated_mean")).alias("difference"))
    return Registration(True, approved, total, "reviewed maps, control minus treated; cells that not all replicates support are unknown", (), maps)
