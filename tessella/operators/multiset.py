"""Multiset comparison of repeat runs: rows are matched by their measurements, never by id."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import percent
from .distribution import quantile_columns


def shared_signatures(rows: DataFrame, run: str, runs, signature, keys=(), drop_unknown: bool = True) -> DataFrame:
    """Per group: rows in both runs (by multiplicity), and rows of one run only.

    With ``drop_unknown`` a row with an unknown measurement takes no part;
    otherwise unknowns equal each other.
    """
    if drop_unknown:
        rows = rows.dropna("any", subset=list(signature))
    a, b = (F.count_if(F.col(run) == r) for r in runs)
    counts = rows.groupBy(*keys, *signature).agg(a.alias("a"), b.alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counts.groupBy(*keys).agg(
        zero(F.sum(F.least("a", "b"))).alias("shared"),
        zero(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0)))).alias("first_only"),
        zero(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0)))).alias("second_only"),
    )


def fingerprint(columns) -> tuple:
    """Two longs of a row's values, and a third one to check them; which values are unknown counts, and -0 is 0."""
    columns = list(columns)
    unknown = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)), F.lit(0))
    return tuple(F.xxhash64(F.lit(seed), unknown, *columns) for seed in (1, 2, 3))


def identical_signatures(rows: DataFrame, run: str, runs, signature, keys=(), drop_unknown: bool = True) -> DataFrame:
    """As :func:`shared_signatures` for signatures of many fields, with the rows of both runs and the percent of the second's rows that the first has too.

    A row is shuffled as 128 bits of its signature with its count, not as its
    fields; two signatures of one fingerprint are an error (they would have to
    agree in 128 bits and differ in a third hash to be seen, and in 192 to be
    missed).
    """
    keys, signature = list(keys), list(signature)
    if len(signature) > 60:
        raise ValueError("more than 60 fields")
    if drop_unknown:
        rows = rows.dropna("any", subset=signature)
    kinds = dict(rows.dtypes)
    plain = rows.select(*keys, run, *((F.col(c) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in signature))
    one, two, check = fingerprint(signature)
    a, b = (F.count_if(F.col(run) == r) for r in runs)
    counts = plain.select(*keys, run, one.alias("_f1"), two.alias("_f2"), check.alias("_f3")).groupBy(*keys, "_f1", "_f2").agg(a.alias("a"), b.alias("b"), F.min("_f3").alias("_lo"), F.max("_f3").alias("_hi"))
    counts = counts.withColumn("a", F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.lit("two signatures share a fingerprint"))).otherwise(F.col("a")))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = counts.groupBy(*keys).agg(zero("a").alias("n_first"), zero("b").alias("n_second"), zero(F.least("a", "b")).alias("shared"))
    return out.select("*", (F.col("n_first") - F.col("shared")).alias("first_only"), (F.col("n_second") - F.col("shared")).alias("second_only"), percent("shared", "n_second").alias("identical_pct"))


def same_keys(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same set of rows."""
    return a.distinct().exceptAll(b.distinct()).isEmpty() and b.distinct().exceptAll(a.distinct()).isEmpty()


def key_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of one side only, by multiplicity: ``side`` is ``missing`` or ``unknown``."""
    found = found.select(*expected.columns)
    return expected.exceptAll(found).withColumn("side", F.lit("missing")).unionByName(found.exceptAll(expected).withColumn("side", F.lit("unknown")))


def run_totals(rows: DataFrame, run: str, runs, pair: str) -> DataFrame:
    """Rows of each class in two runs of a pair, with the change."""
    a, b = (F.count_if(F.col(run) == r) for r in runs)
    return rows.groupBy(pair, "object_type").agg(a.alias("n_first"), b.alias("n_second"), (b - a).alias("change"))


def paired_metrics(rows: DataFrame, run: str, runs, pair: str) -> DataFrame:
    """Metrics of class A in two runs of a pair, from one conditional aggregate, with their changes."""
    out = []
    for name, r in zip(("first", "second"), runs, strict=True):
        on = (F.col(run) == r) & (F.col("object_type") == "A")
        value = lambda c: F.when(on, F.col(c))  # noqa: B023, E731
        out += [
            F.count_if(on).alias(f"n_{name}"),
            percent(F.count_if(on & F.col("b_present")), F.count_if(on)).alias(f"association_{name}"),
            F.avg(value("overlap_pct")).alias(f"mean_overlap_{name}"),
            percent(F.sum(value("overlap_area")), F.sum(value("area"))).alias(f"pooled_overlap_{name}"),
        ]
    a = rows.where("object_type = 'A'").withColumns({f"_{name}": F.when(F.col(run) == r, F.col("area")) for name, r in zip(("first", "second"), runs, strict=True)})
    medians = quantile_columns(a, {f"median_area_{name}": (f"_{name}", 0.5) for name in ("first", "second")}, (pair,))
    wide = rows.groupBy(pair).agg(*out).join(medians, pair, "left")
    wide = wide.withColumn("n_change_pct", percent(F.col("n_second") - F.col("n_first"), "n_first"))
    return wide.select("*", *((F.col(f"{m}_second") - F.col(f"{m}_first")).alias(f"{m}_change") for m in ("association", "mean_overlap", "pooled_overlap", "median_area")))
