"""The design of a study: which columns name sections, replicates, groups and arms, and what each must hold."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite

# Lower edges of the size strata and of the area thresholds.
SIZE_EDGES = (0.0, 0.03, 0.1, 0.3, 1.0)
AREA_THRESHOLDS = (0.0, 0.03, 0.1, 0.3, 1.0)


#: Sections of a design, and what is fetched of them at most.
MAX_SECTIONS = 10_000


def fetched(rows: DataFrame, what: str = "sections") -> list:
    """All rows of a design-sized frame; more than MAX_SECTIONS are an error, never a part of them."""
    got = rows.limit(MAX_SECTIONS + 1).collect()
    if len(got) > MAX_SECTIONS:
        raise ValueError(f"more than {MAX_SECTIONS} {what}")
    return got


@dataclass(frozen=True)
class Design:
    """A balanced two-group design in two arms; ``assignment`` is the recorded group of each replicate, where there is one."""

    section: str = "job"
    replicate: str = "animal"
    group: str = "grp"
    arm: str = "arm"
    groups: tuple = ("control", "treated")
    arms: tuple = ("arm1", "arm2")
    per_group: int = 3
    classes: tuple = ("A", "B")
    assignment: dict | None = None

    def check_metadata(self, metadata: DataFrame) -> None:
        """Known identities, unique sections, unique (replicate, arm), the arms, replicates per group in each arm, every replicate in every arm, one group per replicate, the recorded groups."""
        rows = [r.asDict() for r in fetched(metadata.select(self.section, self.replicate, self.group, self.arm))]
        faults = []
        if any(v is None or not str(v).strip() for r in rows for v in r.values()):
            faults.append("unknown identity")
        if len({r[self.section] for r in rows}) != len(rows):
            faults.append("repeated section")
        if len({(r[self.replicate], r[self.arm]) for r in rows}) != len(rows):
            faults.append("repeated replicate in an arm")
        if {r[self.arm] for r in rows} != set(self.arms):
            faults.append("arms")
        for arm in self.arms:
            for group in self.groups:
                if sum(r[self.arm] == arm and r[self.group] == group for r in rows) != self.per_group:
                    faults.append(f"replicates of {group} in {arm}")
        replicates = {r[self.replicate] for r in rows}
        if any(len({r[self.group] for r in rows if r[self.replicate] == a}) > 1 for a in replicates):
            faults.append("a replicate in two groups")
        if {(r[self.replicate], r[self.arm]) for r in rows} != {(a, arm) for a in replicates for arm in self.arms}:
            faults.append("a replicate missing in an arm")
        if self.assignment is not None and any(self.assignment.get(r[self.replicate]) != r[self.group] for r in rows):
            faults.append("groups differ from the recorded assignment")
        if faults:
            raise ValueError("design: " + ", ".join(faults))

    def metadata_faults(self, metadata: DataFrame) -> DataFrame:
        """The counts behind :meth:`check_metadata`, one row per arm."""
        one = metadata.groupBy(self.replicate).agg(F.countDistinct(self.group).alias("_groups"))
        rows = metadata.join(one, self.replicate)
        return rows.groupBy(self.arm).agg(
            F.count("*").alias("n_sections"),
            (F.count("*") - F.countDistinct(self.section)).alias("repeated_sections"),
            (F.count("*") - F.countDistinct(self.replicate)).alias("repeated_replicates"),
            *(F.count_if(F.col(self.group) == g).alias(f"n_{g}") for g in self.groups),
            F.count_if(F.col("_groups") > 1).alias("in_two_groups"),
        )

    def object_faults(self, objects: DataFrame, metadata: DataFrame) -> DataFrame:
        """Per section of either side: whether the other side has it, rows of unknown class, and areas that are negative or infinite."""
        area = F.col("area")
        counts = objects.groupBy(self.section).agg(
            F.count("*").alias("n"),
            F.count_if(~F.coalesce(F.col("object_type").isin(*self.classes), F.lit(False))).alias("unknown_classes"),
            F.count_if(F.coalesce((area < 0) | F.isnan(area) | (F.abs(area) == float("inf")), F.lit(False))).alias("bad_areas"),
        )
        both = counts.join(metadata.select(self.section).distinct().withColumn("_m", F.lit(True)), self.section, "full_outer")
        return both.select(self.section, F.coalesce("n", F.lit(0)).alias("n"), F.col("_m").isNull().alias("not_in_metadata"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("unknown_classes", "bad_areas")))

    def check_objects(self, objects: DataFrame, metadata: DataFrame) -> None:
        """The same sections on both sides, known classes, areas unknown or finite and not negative."""
        rows = fetched(self.object_faults(objects, metadata))
        if any(not r["n"] or r["not_in_metadata"] for r in rows):
            raise ValueError("objects and metadata name different sections")
        if any(r["unknown_classes"] or r["bad_areas"] for r in rows):
            raise ValueError(f"{sum(r['unknown_classes'] for r in rows)} unknown classes, {sum(r['bad_areas'] for r in rows)} bad areas")

    def attach(self, objects: DataFrame, metadata: DataFrame) -> DataFrame:
        """Objects with their design columns; a section dimension is a few rows, its keys are checked unique."""
        self.check_metadata(metadata)
        return objects.join(F.broadcast(metadata.select(self.section, self.replicate, self.group, self.arm)), self.section)


def identity_mismatch(design: DataFrame, metadata: DataFrame, fields, key: str = "job") -> DataFrame:
    """Fields of ``metadata`` that differ from what ``design`` expects, one row each; a section that only one side has differs in ``key``."""
    a = design.select(key, *(F.col(f).cast("string").alias(f"{f}_expected") for f in fields), F.lit(True).alias("_d"))
    b = metadata.select(key, *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields), F.lit(True).alias("_m"))
    both = a.join(b, key, "full_outer")
    alone = F.col("_d").isNull() | F.col("_m").isNull()
    found = F.when(alone, F.array(F.lit(key))).otherwise(F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"{f}_expected")), F.lit(f)) for f in fields)), lambda x: x.isNotNull()))
    return both.select(key, F.explode(found).alias("field"))


def layout_faults(objects: DataFrame, metadata: DataFrame, key: str = "job", image: str = "image_id", label: str = "image_label") -> DataFrame:
    """Per section what a layout audit may not have: unknown or reversed boxes, odd flags or classes, an image with several labels or none, blank identities."""
    lo_hi = (("xmin", "xmax"), ("ymin", "ymax"))
    unknown = F.greatest(*(finite(c).isNull() for pair in lo_hi for c in pair))
    counts = objects.groupBy(key).agg(
        F.count_if(unknown).alias("unknown_boxes"),
        F.count_if(~unknown & F.greatest(*(F.col(a) > F.col(b) for a, b in lo_hi))).alias("reversed_boxes"),
        F.count_if(~F.coalesce(F.col("object_type").isin("A", "B"), F.lit(False))).alias("unknown_classes"),
    )
    labels = metadata.groupBy(image).agg(F.countDistinct(label).alias("n_labels"))
    blank = F.greatest(*(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in metadata.columns))
    named = metadata.withColumn("blank_identity", blank).join(labels, image).select(key, "n_labels", "blank_identity")
    return counts.join(named, key, "full_outer")


def check_layout(objects: DataFrame, metadata: DataFrame, groups=("control", "treated"), **names) -> None:
    """Raise unless every section is on both sides, boxes are known and ordered, each image has one label, and both groups are there."""
    rows = fetched(layout_faults(objects, metadata, **names))
    bad = [r for r in rows if r["n_labels"] != 1 or r["blank_identity"] or r["unknown_boxes"] is None or r["unknown_boxes"] or r["reversed_boxes"] or r["unknown_classes"]]
    if bad:
        raise ValueError(f"layout: {[r.asDict() for r in bad[:5]]}")
    if {r["grp"] for r in fetched(metadata.select("grp").distinct())} != set(groups):
        raise ValueError("layout: both groups are needed")


def in_display_order(rows: DataFrame, column: str, order) -> DataFrame:
    """``rows`` with ``display_order``, the place (from 0) of a value in a fixed order; others come last."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return rows.withColumn("display_order", F.when(place > 0, place - 1).otherwise(F.lit(len(order))).cast("int"))


def section_metadata(manifest: DataFrame, groups: dict, arms: dict, design: Design | None = None) -> DataFrame:
    """Primary exports with condition label -> group and type -> arm."""
    lookup = lambda c, m: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.col(c))
    out = manifest.where("duplicate_status in ('primary', 'primary_replacement')").withColumn("grp", lookup("condition", groups)).withColumn("arm", lookup("marker", arms))
    if design is not None:
        design.check_metadata(out)
    return out


def metadata_template(summary: DataFrame, key: str = "job", fields=("animal", "grp", "arm", "sex", "age", "batch", "block", "slide", "hemisphere", "notes")) -> DataFrame:
    """One blank row per section, to be filled in."""
    return summary.select(key).distinct().select(key, *(F.lit("").alias(f) for f in fields))


def missing_design(metadata: DataFrame, fields) -> DataFrame:
    """Sections whose design fields are blank, with their names, instead of a guess."""
    blank = F.concat_ws(", ", *(F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "", F.lit(f)) for f in fields))
    return metadata.select("job", blank.alias("missing")).where("missing <> ''")


def review_status(records: DataFrame) -> DataFrame:
    """Readiness per section, with reasons in order; a flag counts only if it is a true boolean."""
    flags = ("landmark_reviewed", "orientation_reviewed", "scale_common_confirmed", "support_reviewed")
    for f in (*flags, "support_qc"):
        if dict(records.dtypes).get(f) != "boolean":
            raise TypeError(f"{f} must be boolean")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    why = F.concat_ws(
        "; ",
        F.when(F.col("reviewed_polygon").isNull() | no("landmark_reviewed"), "landmark not reviewed"),
        F.when(no("orientation_reviewed"), "orientation not reviewed"),
        F.when(no("scale_common_confirmed"), "scale not confirmed"),
        F.when(no("support_reviewed") | no("support_qc"), "support not approved"),
        F.when(blank("reviewer"), "no reviewer"),
        F.when((F.coalesce(F.col("orientation"), F.lit("none")) != "none") & (blank("second_reviewer") | (F.col("second_reviewer") == F.col("reviewer"))), "flip needs a second reviewer"),
    )
    return records.select("job", (why == "").alias("ready"), why.alias("reasons"))


def gate(records: DataFrame, objects: DataFrame, expected: int = 12) -> list:
    """Why group maps may not be made yet; empty if they may.  Reads the review records only: one per section."""
    status = fetched(review_status(records), "review records")
    faults = []
    if len(status) != expected or len({r["job"] for r in status}) != expected:
        faults.append(f"{len(status)} records, {expected} expected")
    jobs = {r["job"] for r in fetched(objects.select("job").distinct())}
    if jobs != {r["job"] for r in status}:
        faults.append("records and objects name different sections")
    return faults + [f"{r['job']}: {r['reasons']}" for r in status if not r["ready"]]
