"""Exact distributions and rankings.  Every order is total, so results do not depend on row order.

A group may hold a third of all rows, so no window runs over a whole group:
values are dealt to buckets between cut points of their group, windows run
within a bucket, and the totals of the buckets before give the rest.  Equal
values are counted before they move.  Cut points only balance the work; results
do not depend on them.
"""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent

#: Buckets of a group, and groups whose cut points are fetched at most.
BUCKETS, MAX_GROUPS = 64, 10_000


def cut_points(rows: DataFrame, value: str, keys) -> DataFrame:
    """``(keys, cuts)``: increasing values that part each group into about equal pieces.

    They are fetched once, so that every use of them agrees; a group is a row of
    a study's design, and more than MAX_GROUPS of them are an error.
    """
    found = rows.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("cuts"))
    got = found.limit(MAX_GROUPS + 1).collect()
    if len(got) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    cuts = rows.sparkSession.createDataFrame(got, found.schema)
    return cuts.withColumn("cuts", F.array_distinct(F.coalesce("cuts", F.array().cast("array<double>"))))


def bucketed(rows: DataFrame, value: str, keys, cuts: DataFrame) -> DataFrame:
    """``rows`` with ``_b``: how many of the group's cuts lie below the value."""
    return rows.join(F.broadcast(cuts), list(keys)).withColumn("_b", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")


def _histogram(rows: DataFrame, value: str, keys) -> DataFrame:
    """``(keys, value, _n, _b)``: known distinct values with their counts and buckets; a group with an unknown key has none.

    Unknown keys are dropped here, not by the joins, whose own filters would
    differ from branch to branch: all branches then read one shuffle of counts.
    """
    known = rows
    for c in (value, *keys):
        known = known.where(F.col(c).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return bucketed(counts, value, keys, cut_points(known, value, keys))


def _running(order) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, 0)


def quantiles(rows: DataFrame, value: str, keys, probabilities) -> DataFrame:
    """``(keys, i, probability, value)``: exact quantiles, linear between ranks; unknown values take no part.

    Only the buckets that hold a wanted rank are sorted.
    """
    keys = list(keys)
    placed = _histogram(rows, value, keys)
    per, w = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_c")), Window.partitionBy(*keys)
    per = per.select(*keys, "_b", "_c", (F.sum("_c").over(_running(w.orderBy("_b"))) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_total"))
    wanted = F.transform(F.array(*(F.lit(float(p)) for p in probabilities)), lambda p, i: F.struct(i.alias("i"), p.alias("p"), ((F.col("_total") - 1) * p).alias("at")))
    inside = lambda lo, n: lambda q: (F.floor(q["at"]) < lo + n) & (F.ceil(q["at"]) >= lo)
    need = per.withColumn("_wanted", F.filter(wanted, inside(F.col("_before"), F.col("_c")))).where(F.size("_wanted") > 0).drop("_c", "_total")
    ranked = placed.join(need, [*keys, "_b"]).withColumn("_lo", F.col("_before") + F.sum("_n").over(_running(Window.partitionBy(*keys, "_b").orderBy(value))) - F.col("_n"))
    # a row is met by a wanted place if it holds the rank below or above it
    met = ranked.select(*keys, F.col(value).alias("_v"), F.explode(F.filter("_wanted", inside(F.col("_lo"), F.col("_n")))).alias("_q"))
    out = met.groupBy(*keys, F.col("_q.i").alias("i"), F.col("_q.p").alias("probability"), F.col("_q.at").alias("_at")).agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    return out.select(*keys, "i", "probability", (F.col("_a") + (F.col("_at") - F.floor("_at")) * (F.col("_z") - F.col("_a"))).alias("value"))


#: Accuracy of the digests that brackets are taken from, how far a bracket reaches beyond its rank on each side
#: (three times the digests' greatest error), and rows of a group up to which all values are within a bracket.
ACCURACY, MARGIN, WHOLE = 1000, 0.003, 10_000


def _brackets(n: int, marks: list, found: list) -> tuple:
    """Closed intervals that hold the values of all wanted ranks, as ``(lows, highs)``; ``found``: values at ``marks``, pairs of low and high places."""
    if n <= WHOLE:
        return [float("-inf")], [float("inf")]
    lows, highs = [], []
    for i in range(0, len(marks), 2):
        low = found[i] if marks[i] > 0 else float("-inf")
        high = found[i + 1] if marks[i + 1] < 1 else float("inf")
        if highs and low <= highs[-1]:
            highs[-1] = max(highs[-1], high)
        else:
            lows.append(low)
            highs.append(high)
    return lows, highs


def selected(rows: DataFrame, wanted: dict, shares: dict, keys, extra=()) -> DataFrame:
    """``(keys, extra, name...)``: exact quantiles and top shares of several columns, and any other aggregates, in two readings of the table.

    ``wanted``: name -> (column, probability), linear between ranks; ``shares``:
    name -> (column, share), the percent of the column's sum that its largest
    ``max(1, ceil(share * n))`` rows hold; ``extra``: aggregates.  Unknown
    values take no part, groups with an unknown key are left out.

    The first reading gives ``extra`` and, from digests of known greatest error,
    brackets that hold the values of all wanted ranks.  The second counts and
    sums what lies between brackets, and moves single values only within them.
    """
    keys, marks = list(keys), {}
    for column, p in [*wanted.values(), *((c, 1 - share) for c, share in shares.values())]:
        marks.setdefault(column, set()).add(p)
    places = {c: [m for p in sorted(ps) for m in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))] for c, ps in marks.items()}
    columns, number = list(places), lambda c: F.col(c).cast("double")
    known = rows.where(" and ".join(f"`{k}` is not null" for k in keys)) if keys else rows
    digests = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"_n{i}"), F.percentile_approx(number(c), [float(m) for m in places[c]], ACCURACY).alias(f"_at{i}"))]
    first = known.groupBy(*keys).agg(*extra, *digests)
    got = first.limit(MAX_GROUPS + 1).collect()
    if len(got) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    spark, kinds = rows.sparkSession, dict(first.dtypes)
    typed = [f"`{k}` {kinds[k]}" for k in keys]
    cuts = [(*(r[k] for k in keys), i, *_brackets(r[f"_n{i}"], places[c], r[f"_at{i}"])) for r in got for i, c in enumerate(columns) if r[f"_n{i}"]]
    most = max((len(r[-2]) for r in cuts), default=0)
    cuts = spark.createDataFrame(cuts, ", ".join([*typed, "_metric int, _lows array<double>, _highs array<double>"]))

    # not unpivot: its copies rename the keys, and filters on them then differ from branch to branch
    long = known.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).alias("_metric"), number(c).alias("_value")) for i, c in enumerate(columns))))).where("_value is not null")
    keys_m = [*keys, "_metric"]
    # Every row passes here: comparisons one by one are compiled, a lambda over the array would not be.
    begun = sum((F.when(F.get("_lows", F.lit(j)) <= F.col("_value"), 1).otherwise(0) for j in range(most)), F.lit(0))
    placed = long.join(F.broadcast(cuts), keys_m).withColumn("_i", begun)
    within = (F.col("_i") > 0) & (F.col("_value") <= F.get("_highs", F.col("_i") - 1))
    # Never null, and not filtered on below: both branches then read one shuffle.
    placed = placed.withColumn("_b", F.coalesce(2 * F.col("_i") - F.when(within, 1).otherwise(0), F.lit(0))).withColumn("_v", F.when(within, F.col("_value")))
    placed = placed.groupBy(*keys_m, "_b", "_v").agg(F.count("*").alias("_n"), F.sum("_value").alias("_s"))

    per, w = placed.groupBy(*keys_m, "_b").agg(F.sum("_n").alias("_c"), F.sum("_s").alias("_t")), Window.partitionBy(*keys_m)
    per = per.select("*", (F.sum("_c").over(_running(w.orderBy("_b"))) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_total"), (F.sum("_t").over(_running(w.orderBy(F.desc("_b")))) - F.col("_t")).alias("_over"), F.sum("_t").over(w).alias("_all"))
    ask = lambda kind, c, p: F.struct(F.lit(columns.index(c)).alias("c"), F.lit(kind).alias("kind"), F.lit(float(p)).alias("p"))
    asked = F.array(*(ask("rank", c, p) for c, p in sorted(set(wanted.values()))), *(ask("top", c, p) for c, p in sorted(set(shares.values()))))
    mine = F.transform(F.filter(asked, lambda q: q["c"] == F.col("_metric")), lambda q: F.struct(q["kind"].alias("kind"), q["p"].alias("p"), F.when(q["kind"] == "rank", (F.col("_total") - 1) * q["p"]).otherwise(F.col("_total") - F.greatest(F.lit(1), F.ceil(q["p"] * F.col("_total")))).alias("at")))
    inside = lambda lo, n: lambda q: (F.floor(q["at"]) < lo + n) & (F.ceil(q["at"]) >= lo)
    need = per.withColumn("_wanted", F.filter(mine, inside(F.col("_before"), F.col("_c")))).where(F.size("_wanted") > 0)
    # By the digests' bound no wanted rank lies outside the brackets; if one did, that would be an error and not a wrong number.
    need = need.withColumn("_b", F.when(F.col("_b") % 2 == 0, F.raise_error(F.lit("a wanted rank lies outside its bracket"))).otherwise(F.col("_b"))).drop("_t")
    run = _running(Window.partitionBy(*keys_m, "_b").orderBy("_v"))
    ranked = placed.join(need, [*keys_m, "_b"]).withColumn("_lo", F.col("_before") + F.sum("_n").over(run) - F.col("_n")).withColumn("_sum", F.sum("_s").over(run) - F.col("_s"))
    inner = F.sum("_s").over(Window.partitionBy(*keys_m, "_b"))
    met = ranked.withColumn("_inner", inner).select(*keys_m, "_v", "_n", "_lo", "_sum", "_inner", "_over", "_all", F.explode(F.filter("_wanted", inside(F.col("_lo"), F.col("_n")))).alias("_q"))
    # Of the row that holds the first of the top ranks, the copies from that rank on count, and all that is above it.
    top = F.col("_over") + F.col("_inner") - F.col("_sum") - (F.col("_q.at") - F.col("_lo")) * F.col("_v")
    at = F.col("_q.at")
    out = met.groupBy(*keys_m, F.col("_q.kind").alias("_kind"), F.col("_q.p").alias("_p"), at.alias("_at")).agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.max(percent(top, "_all")).alias("_share"))
    value = F.when(F.col("_kind") == "rank", F.col("_a") + (F.col("_at") - F.floor("_at")) * (F.col("_z") - F.col("_a"))).otherwise(F.col("_share"))
    pick = lambda kind, c, p: F.max(F.when((F.col("_metric") == columns.index(c)) & (F.col("_kind") == kind) & (F.col("_p") == float(p)), F.col("_found")))
    out = out.withColumn("_found", value).groupBy(*keys).agg(*(pick("rank", c, p).alias(n) for n, (c, p) in wanted.items()), *(pick("top", c, p).alias(n) for n, (c, p) in shares.items()))
    if not extra:
        return out
    plain = first.drop(*(d for i in range(len(columns)) for d in (f"_n{i}", f"_at{i}")))
    base = spark.createDataFrame([tuple(r[c] for c in plain.columns) for r in got], plain.schema)
    return base.join(out, keys, "left")


def quantile_columns(rows: DataFrame, wanted: dict, keys) -> DataFrame:
    """``(keys, name...)``: exact quantiles of several columns; ``wanted``: name -> (column, probability)."""
    return selected(rows, wanted, {}, keys)


def top_share(rows: DataFrame, keys, value: str, share: float = 0.01) -> DataFrame:
    """Percent of the group's ``value`` that its largest ``max(1, ceil(share * n))`` rows hold."""
    return selected(rows, {}, {"top_share_pct": (value, share)}, keys)


def ecdf(rows: DataFrame, value: str, keys) -> DataFrame:
    """Distinct known values with their counts and the percentage of rows at or below."""
    keys = list(keys)
    placed, w = _histogram(rows, value, keys), Window.partitionBy(*keys)
    per = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_c"))
    per = per.select(*keys, "_b", (F.sum("_c").over(_running(w.orderBy("_b"))) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_total"))
    running = F.col("_before") + F.sum("_n").over(_running(Window.partitionBy(*keys, "_b").orderBy(value)))
    return placed.join(per, [*keys, "_b"]).select(*keys, value, F.col("_n").alias("n"), percent(running, "_total").alias("cumulative_pct"))


def _ties(known: DataFrame, value: str, keys, id_column: str, cuts: DataFrame):
    """``(per, ties)``: counts and sums of the buckets, and ``(keys, _b, _ids)`` for values that hold two buckets' worth of a group or more (None without such).

    Such a value is a cut point, the greatest value of its bucket.  ``_ids``
    parts its rows by id into pieces as large as a bucket; the ids come from a
    sample by their hash, of about 64 per piece, so they too only balance the work.
    """
    at = known.join(F.broadcast(cuts), keys).withColumn("_b", F.size(F.filter("cuts", lambda c: c < F.col(value)))).withColumn("_cut", F.get("cuts", F.col("_b"))).drop("cuts")
    equal = F.col(value).cast("double") == F.col("_cut")
    found = at.groupBy(*keys, "_b").agg(F.count("*").alias("_c"), F.sum(value).alias("_s"), F.count_if(equal).alias("_tied"), (F.min(F.when(equal, F.col(value))) == F.max(F.when(equal, F.col(value)))).alias("_one"))
    got = found.collect()  # at most BUCKETS rows for each of MAX_GROUPS groups
    spark, of = known.sparkSession, lambda r: tuple(r[k] for k in keys)
    per = spark.createDataFrame([(*of(r), r["_b"], r["_c"], r["_s"]) for r in got], found.select(*keys, "_b", "_c", "_s").schema)
    total: dict = {}
    for r in got:
        total[of(r)] = total.get(of(r), 0) + r["_c"]
    pieces = [(*of(r), r["_b"], r["_tied"] * BUCKETS // total[of(r)], r["_tied"]) for r in got if r["_one"] and r["_tied"] * BUCKETS >= 2 * total[of(r)]]
    if not pieces:
        return per, None
    typed = ", ".join(f"`{k}` {dict(found.dtypes)[k]}" for k in keys)
    wanted = spark.createDataFrame(pieces, f"{typed}, _b int, _p long, _tied long")
    step = F.greatest(F.lit(1), F.floor(F.col("_tied") / (64 * F.col("_p"))))
    drawn = at.where(equal).join(F.broadcast(wanted), [*keys, "_b"]).where(F.pmod(F.xxhash64(id_column), step) == 0)
    sample = drawn.groupBy(*keys, "_b", "_p").agg(F.sort_array(F.collect_set(id_column)).alias("_ids"))
    place = lambda j: F.floor(F.size("_ids") * j / F.col("_p")).cast("int")
    ids = F.array_distinct(F.transform(F.sequence(F.lit(1).cast("long"), F.col("_p") - 1), lambda j: F.get("_ids", place(j))))
    ties = sample.where(F.size("_ids") > 0).select(*keys, "_b", ids.alias("_ids"))
    return per, spark.createDataFrame(ties.collect(), ties.schema)  # at most 2 * BUCKETS ids for each group


def concentration(rows: DataFrame, value: str, keys, id_column: str = "object_id") -> DataFrame:
    """Largest first: rank, percent of rows so far and percent of the value so far; ties by id (unknown first).

    Unknown values take no part; a group with an unknown key has no rows.  A
    value that very many rows of a group hold is ranked in pieces by id; only
    rows equal in value and id, which are true ties, stay in one piece.
    """
    keys = list(keys)
    known = rows.where(F.col(value).isNotNull()).select(*keys, id_column, value)
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    cuts = cut_points(known, value, keys)
    per, ties = _ties(known, value, keys, id_column, cuts)
    w, section = Window.partitionBy(*keys), [*keys, "_b", "_part"]
    if ties is None:
        placed, per = bucketed(known, value, keys, cuts).withColumn("_part", F.lit(0)), per.withColumn("_part", F.lit(0))
    else:
        # The tied value is the greatest of its bucket: its pieces come first.
        of = F.size(F.filter("_ids", lambda c: c < F.col(id_column)))
        placed = known.join(F.broadcast(cuts), keys).withColumn("_b", F.size(F.filter("cuts", lambda c: c < F.col(value)))).withColumn("_cut", F.get("cuts", F.col("_b"))).drop("cuts")
        placed = placed.join(F.broadcast(ties), [*keys, "_b"], "left")
        placed = placed.withColumn("_part", F.when(F.col("_ids").isNull() | (F.col(value).cast("double") != F.col("_cut")), BUCKETS).otherwise(F.when(F.col(id_column).isNull(), 0).otherwise(of))).drop("_cut", "_ids")
        per = placed.groupBy(*section).agg(F.count("*").alias("_c"), F.sum(value).alias("_s"))
    above = lambda c: F.sum(c).over(_running(w.orderBy(F.desc("_b"), "_part"))) - F.col(c)
    per = per.select(*section, above("_c").alias("_rows"), above("_s").alias("_sum"), F.sum("_c").over(w).alias("_n"), F.sum("_s").over(w).alias("_t"))
    order = _running(Window.partitionBy(*section).orderBy(F.desc(value), id_column))
    ranked = placed.join(per, section).withColumn("rank", (F.col("_rows") + F.count("*").over(order)).cast("int")).withColumn("_s", F.col("_sum") + F.sum(value).over(order))
    return ranked.select(*keys, id_column, "rank", percent("rank", "_n").alias("objects_pct"), percent("_s", "_t").alias("value_pct"))


def quantile_curve(rows: DataFrame, value: str, keys, points: int = 201) -> DataFrame:
    """Exact quantiles at evenly spaced probabilities, one row each."""
    return quantiles(rows, value, keys, [i / (points - 1) for i in range(points)]).drop("i")


def top_rows(rows: DataFrame, value: str, keys, n: int = 5, id_column: str = "object_id", name: str = "rank") -> DataFrame:
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), id_column)))
    return ranked.where(F.col(name) <= n)


def kept(df: DataFrame) -> DataFrame:
    """Computed once and read from there by all that follows: a checkpoint in ``spark.checkpoint.dir``, or beside the executors where that is unset."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


#: Rows of a piece of :func:`numbered`, and how many ids the sample draws of a piece, about.
PIECE, DRAWN = 1 << 18, 64


def numbered(rows: DataFrame, id_column: str, keys, name: str = "number") -> DataFrame:
    """``rows`` with their place (a long, from 0) in their group by id, unknown ids first; no task holds a group.

    A group is cut by id into pieces of about PIECE rows, so there are more
    pieces, not larger ones, where it grows; a window runs over a piece, and the
    rows of the pieces before it are added.  The cuts come from a sample by the
    ids' hash and only balance the work.  Only rows equal in id, whose order is
    open, stay in one piece.
    """
    keys, spark = list(keys), rows.sparkSession
    names = [f"_k{i}" for i in range(len(keys))]
    drawn = F.when(F.pmod(F.xxhash64(id_column), F.lit(max(1, PIECE // DRAWN))) == 0, F.col(id_column))
    sample = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.sort_array(F.collect_set(drawn)).alias("_ids"))
    every = F.sequence(F.lit(DRAWN - 1), F.size("_ids") - 1, F.lit(DRAWN))
    found = sample.select(*names, F.when(F.size("_ids") >= DRAWN, F.transform(every, lambda i: F.get("_ids", i))).alias("_cuts"))
    got = found.limit(MAX_GROUPS + 1).collect()  # an id for each piece
    if len(got) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    same = lambda: F.lit(True) if not keys else reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)))
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(id_column))), F.lit(0))
    placed = rows.join(F.broadcast(spark.createDataFrame(got, found.schema)), same()).withColumn("_b", F.when(F.col("_cuts").isNull(), 0).otherwise(piece))
    counts: dict = {}
    for r in placed.groupBy(*names, "_b").agg(F.count("*").alias("_n")).collect():  # a row for each piece
        counts.setdefault(tuple(r[n] for n in names), {})[r["_b"]] = r["_n"]
    before = [(*key, [sum(c for b, c in of.items() if b < i) for i in range(max(of) + 1)]) for key, of in counts.items()]
    kinds = dict(found.dtypes)
    before = spark.createDataFrame(before, ", ".join([*(f"{n} {kinds[n]}" for n in names), "_before array<long>"]))
    placed = placed.drop(*names, "_cuts").join(F.broadcast(before), same())
    # As many tasks as pieces, whatever the session's number of partitions.
    placed = placed.repartition(max(1, sum(map(len, counts.values()))), *keys, "_b")
    number = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(id_column)) - 1
    return placed.withColumn("_at", F.get("_before", F.col("_b"))).drop("_before", *names).withColumn(name, F.col("_at") + number).drop("_at", "_b")


def nearest_to(rows: DataFrame, value: str, target, keys, id_column: str = "object_id") -> DataFrame:
    """The row whose value is nearest to a quantile of its group (``target``: a probability), ties by id."""
    keys = list(keys)
    found = quantiles(rows, value, keys, [target]).select(*keys, F.col("value").alias("target"))
    aim = rows.sparkSession.createDataFrame(found.collect(), found.schema)  # a row for each of MAX_GROUPS groups at most
    return _least(rows.join(F.broadcast(aim), keys), F.abs(F.col(value) - F.col("target")), keys, id_column).select(*keys, "target", id_column, value)


def _least(rows: DataFrame, measure, keys, id_column: str) -> DataFrame:
    """The row of least known ``measure`` per group, ties by id; only rows that hold the least meet their ids, so rows are not sorted."""
    measured = rows.withColumn("_m", measure)
    least = measured.groupBy(*keys).agg(F.min("_m").alias("_least"))
    tied = measured.join(F.broadcast(least), list(keys)).where(F.col("_m") == F.col("_least")).drop("_m", "_least")
    others = [c for c in rows.columns if c not in (*keys, id_column)]
    first = tied.groupBy(*keys).agg(F.min(F.struct(id_column, *others)).alias("_r"))
    return first.select(*keys, "_r.*")


def extreme_row(rows: DataFrame, measure, keys, payload, id_column: str) -> DataFrame:
    """The row of greatest ``measure`` per group; ties take the least id."""
    order = F.struct((-measure).alias("m"), F.col(id_column).alias("i"))
    return rows.groupBy(*keys).agg(*(F.min_by(F.col(c), order).alias(c) for c in payload))


def review_queue(rows: DataFrame, value: str, odd, keys=("job",), id_column: str = "object_id", seed: int = 7, sizes=(3, 3, 2)) -> DataFrame:
    """Rows to look at: some at random (by md5 of seed and id), the largest, and the first odd ones; a row may have several reasons."""
    kinds = (("random", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string"))), F.lit(True)), ("largest", -F.col(value), F.lit(True)), ("odd", F.col(id_column), odd))
    out = None
    for (reason, order, keep), n in zip(kinds, sizes, strict=True):
        part = rows.where(keep).select(*keys, id_column, F.lit(reason).alias("reason"), F.row_number().over(Window.partitionBy(*keys).orderBy(order, id_column)).alias("place")).where(F.col("place") <= n)
        out = part if out is None else out.unionByName(part)
    return out


def first_per_bin(rows: DataFrame, keys, order) -> DataFrame:
    """One row per key combination, the first by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
