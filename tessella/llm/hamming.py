"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments about as wide as the logarithm of their number, so
that a segment value has about one code.  Two codes at distance d differ by at
most ``d // m`` bits in one of their m segments, so when all segments have been
searched to radius r, every code at distance ``m * (r + 1) - 1`` or less has
been found.  A round looks up, for each open code, the segment values at some
radii; a code closes when its k-th verified distance is covered.  Radii grow
until every code is closed, which is at the width of a segment at the latest:
then every pair has been met, by the index like all others.  A pair is verified
once: in the first segment of least distance.

Rows of one code are one entry of the index and one question, with their k + 1
least ids: a code held by a third of the rows is looked up once and verified
once.  A segment value that many codes share is spread over several tasks.

Null or empty vectors, and vectors of another width than the most frequent one
(of equally frequent ones the widest), have no code: they neither ask nor
answer, and a warning tells their number.  Null and NaN elements count as 0.
Rows that repeat an id are one row, with the least of their codes.
"""

import logging
import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, table

#: Bits of an item of a code, and of a segment at most.
SEGMENT = 16
#: Codes of one segment value that a task meets.
SALTED = 512
#: Lookups of a question in one segment that may share a round, by expected codes.
ROUND = 300

log = logging.getLogger(__name__)


def sign_codes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(id, code array<int>)``: one bit per element (1 if positive), SEGMENT bits per item."""
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].alias("v")).where("id is not null and size(v) > 0")
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"))
    found = widths.agg(F.max(F.struct("n", "w")).alias("most"), F.sum("n").alias("all")).first()
    width = found["most"]["w"] if found["most"] else 0
    if width and found["all"] > found["most"]["n"]:
        log.warning("%d vectors are not of width %d and have no code", found["all"] - found["most"]["n"], width)
    item = lambda s: sum(
        (F.when((F.get("v", F.lit(i)) > 0) & ~F.isnan(F.get("v", F.lit(i))), F.lit(1 << (i - s))).otherwise(F.lit(0)) for i in range(s, min(s + SEGMENT, width))), F.lit(0)
    )
    code = F.array(*(item(s) for s in range(0, width, SEGMENT))) if width else F.array().cast("array<int>")
    return rows.where(F.size("v") == width).select("id", code.cast("array<int>").alias("code"))


def distance(a: str, b: str, segments: int):
    """Hamming distance of two code columns."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(segments)), F.lit(0)).cast("int")


def segment_values(code: str, items: int, width: int) -> list:
    """The code's segments of ``width`` bits, each an integer column; the last one may be shorter."""
    out = []
    for first in range(0, items * SEGMENT, width):
        item, shift = divmod(first, SEGMENT)
        value = F.shiftright(F.get(code, F.lit(item)), shift)
        if shift + width > SEGMENT and item + 1 < items:
            value = value.bitwiseOR(F.shiftleft(F.get(code, F.lit(item + 1)), SEGMENT - shift))
        out.append(value.bitwiseAND(F.lit((1 << width) - 1)))
    return out


def masks(spark, radii, width: int = SEGMENT) -> DataFrame:
    """``(mask, radius)``: all masks of ``width`` bits with as many ones as the radii say; at most 65,536 rows, whatever the data."""
    return spark.createDataFrame([(sum(1 << i for i in c), r) for r in radii for c in combinations(range(width), r)], "mask int, radius int")


def rounds(n: int, width: int) -> list:
    """Radii of each round, from 0 to ``width``: the first ones together while they are few lookups, then one by one."""
    first, size, each = [], 0, max(1.0, n / 2**width)
    for r in range(width + 1):
        size += math.comb(width, r) * each
        if first and size > ROUND:
            break
        first.append(r)
    return [first, *([r] for r in range(len(first), width + 1))]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, width: int | None = None) -> DataFrame:
    """``(query_id, neighbor_id, distance, rank)``: for each query the k other rows nearest in Hamming distance, ties by id.

    ``codes`` and ``queries``: ``(id, code)``; further columns are not read.  A
    query is not its own neighbour.  Fewer than k other rows give fewer answers.
    ``width``: bits of a segment, from the number of codes unless given.
    """
    spark = codes.sparkSession
    with scratch(spark) as keep:
        codes, queries = (table(df.groupBy("id").agg(F.min("code").alias("code")), name) for df, name in ((codes, "codes"), (queries, "queries")))
        items = codes.agg(F.max(F.size("code"))).first()[0]
        if not items:
            return spark.createDataFrame([], "query_id long, neighbor_id long, distance int, rank int")
        entries = _entries(codes, k)
        asked = table(queries.select(F.col("code").alias("asked")).distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
        best = _nearest_codes(asked, entries, items, k, width)
        # k codes of the least (distance, least id) hold the k nearest rows; one more, as the query may be one of them
        rows = best.join(entries.select("code", "ids"), "code").select("q", F.explode(F.transform("ids", lambda i: F.struct("distance", i.alias("id")))).alias("n"))
        near = rows.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("n")), 1, k + 1).alias("near")).join(asked, "q")
        mine = queries.select(F.col("id").alias("query_id"), F.col("code").alias("asked")).join(near.select("asked", "near"), "asked")
        others = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
        out = mine.select("query_id", F.posexplode(others).alias("rank", "n"))
        return keep(out.select("query_id", F.col("n.id").alias("neighbor_id"), F.col("n.distance").alias("distance"), (F.col("rank") + 1).alias("rank")), "neighbours")


def _entries(codes: DataFrame, k: int) -> DataFrame:
    """``(code, ids, least, n)``: the k + 1 least ids of each code, first within salts, then within the code."""
    ordered = Window.partitionBy("code", "salt").orderBy("id")
    few = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(ordered)).where(F.col("r") <= k + 1)
    few = few.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    return table(few.select("code", "ids", F.get("ids", F.lit(0)).alias("least"), F.size("ids").alias("n")), "entries")


def _first_found(items: int, width: int):
    """Whether a pair's first segment of least distance is ``segment``, at ``radius``."""
    apart = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(segment_values("asked", items, width), segment_values("code", items, width), strict=True)]
    out = F.lit(True)
    for i, d in enumerate(apart):
        out = out & ((F.col("segment") <= i) | (d > F.col("radius"))) & ((F.col("segment") >= i) | (d >= F.col("radius")))
    return out


def _nearest_codes(asked: DataFrame, entries: DataFrame, items: int, k: int, width: int | None = None) -> DataFrame:
    """``(q, code, distance, least, n)``: for each of ``asked`` the k + 1 codes of least (distance, least id)."""
    spark, n = asked.sparkSession, entries.count()
    width = min(SEGMENT, max(4, n.bit_length())) if width is None else width
    segments = -(-items * SEGMENT // width)
    cut = lambda code: F.posexplode(F.array(*segment_values(code, items, width))).alias("segment", "value")
    index = entries.select("code", "least", "n", cut("code"))
    hot = index.groupBy("segment", "value").agg(F.count("*").alias("m")).where(F.col("m") > SALTED)
    hot = table(hot.select("segment", "value", F.ceil(F.col("m") / SALTED).alias("salts")), "hot-values")
    spread = F.coalesce("salts", F.lit(1))
    index = table(index.join(hot, ["segment", "value"], "left").select("segment", "value", F.pmod(F.xxhash64("code"), spread).alias("salt"), "code", "least", "n"), "index")
    # a pair beyond the k + 1 nearest so far can change nothing
    asked, best, closed = asked.withColumn("bound", F.lit(None).cast("int")), None, None
    nearer = F.col("bound").isNull() | (distance("asked", "code", items) <= F.col("bound"))
    for radii in rounds(n, width):
        probes = asked.select("q", "asked", "bound", cut("asked"))
        probes = probes.crossJoin(F.broadcast(masks(spark, radii, width))).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
        probes = probes.join(hot, ["segment", "value"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1))).drop("salts")
        found = probes.join(index, ["segment", "value", "salt"]).where(_first_found(items, width) & nearer)
        found = found.select("q", "code", distance("asked", "code", items).alias("distance"), "least", "n")
        best = table(_nearest(found if best is None else best.unionByName(found), k), f"round-{radii[-1]}")
        if radii[-1] == width:  # every pair has been met
            return best if closed is None else closed.unionByName(best)
        covered = segments * (radii[-1] + 1) - 1
        held = lambda c: F.coalesce(F.sum(c), F.lit(0)) > k
        state = best.groupBy("q").agg(held(F.when(F.col("distance") <= covered, F.col("n"))).alias("done"), F.when(held("n"), F.max("distance")).alias("bound"))  # noqa: B023
        asked = table(asked.drop("bound").join(state, "q", "left").where("not coalesce(done, false)").drop("done"), "open")
        if asked.isEmpty():
            return best if closed is None else closed.unionByName(best)
        now = best.join(asked.select("q"), "q", "left_anti")
        closed = now if closed is None else closed.unionByName(now)
        best = best.join(asked.select("q"), "q", "left_semi")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 codes of least (distance, least id) for each ``q``: first within salts, so that no task sorts all of one."""
    salted = found.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(16)))
    for keys in (("q", "salt"), ("q",)):
        order = Window.partitionBy(*keys).orderBy("distance", "least")
        salted = salted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    return salted.select("q", "code", "distance", "least", "n")
