"""Resharding by minimum-cost flow: from old shards to new ones, moving the fewest bytes.

1. Sizes of the old shards are summed (one row each, at most MOST_SHARDS).
   Documents larger than a 256th of a new shard - fewer than 256 per new
   shard, whatever the corpus - are placed one by one, largest first: at home
   where there is room, else in the emptiest shard.
2. What is left of each capacity and the old shards' other bytes are a
   transport problem: :func:`transfers` solves it exactly by successive
   shortest paths.  A byte that stays at home costs nothing, any other one.
3. A flow of x bytes from an old shard to a new one is a range of x bytes in
   the old shard's order.  Documents are put in order by a hash of their text
   within blocks whose sizes are summed first, so no task orders a whole shard.
   Equal texts of one old shard lie together and are not parted where all of
   them together are below a 256th of a shard (large ones: an eighth); more of
   them than that are.
4. :func:`rewrite` writes only the partitions that change.
"""

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, scratch, table

MOST_SHARDS, ROW_BYTES, FINE = 10_000, 16, 256
#: Rows of a block, and blocks at most (a block grows beyond that).
BLOCK, BLOCKS = 1024, 100_000


def transfers(supply, capacity, cost) -> np.ndarray:
    """``flow[old, new]``: units that go from each old shard to each new one at the least total cost.

    Integers; ``sum(supply) <= sum(capacity)``; ``cost[old, new]`` per unit.
    Old shards are added one after the other, each along shortest paths over
    the new shards in the residual network, so the flow is optimal after each.
    """
    supply, room, cost = np.asarray(supply, np.int64), np.array(capacity, np.int64), np.asarray(cost, np.float64)
    if supply.sum() > room.sum():
        raise ValueError("capacities do not hold the supplies")
    m, n = cost.shape
    flow = np.zeros((m, n), np.int64)
    arc, via = np.full((n, n), np.inf), np.zeros((n, n), np.int64)  # cheapest way to pass a unit on from j to k, and whose

    def refresh(j):
        users = np.flatnonzero(flow[:, j])
        if not len(users):
            arc[j] = np.inf
            return
        change = cost[users] - cost[users, j][:, None]
        pick = change.argmin(axis=0)
        arc[j], via[j] = change[pick, np.arange(n)], users[pick]

    for i in range(m):
        left = int(supply[i])
        while left:
            distance, before = cost[i].copy(), np.full(n, -1)
            while True:
                through = distance[:, None] + arc
                pick = through.argmin(axis=0)
                shorter = through[pick, np.arange(n)] < distance - 1e-9
                if not shorter.any():
                    break
                distance[shorter], before[shorter] = through[pick, np.arange(n)][shorter], pick[shorter]
            end = int(np.where(room > 0, distance, np.inf).argmin())
            path = [end]
            while before[path[-1]] >= 0:
                path.append(int(before[path[-1]]))
            path.reverse()
            steps = [(int(via[j, k]), j, k) for j, k in zip(path, path[1:], strict=False)]
            units = min(left, int(room[end]), *(int(flow[o, j]) for o, j, _ in steps))
            flow[i, path[0]] += units
            for o, j, k in steps:
                flow[o, j] -= units
                flow[o, k] += units
            room[end] -= units
            left -= units
            for j in path:
                refresh(j)
    return flow


def _filled(load, total: int) -> np.ndarray:
    """Capacities that sum to ``total`` and bring all loads as near to one level as loads allow; they differ by one at most where they are filled."""
    load, ordered = np.asarray(load, np.int64), np.sort(load)
    n = len(load)
    for k in range(n, 0, -1):
        level, over = divmod(int(ordered[:k].sum()) + total, k)
        if level >= ordered[k - 1]:
            break
    out = np.maximum(level - load, 0)
    below = np.flatnonzero(load <= level)[:over]
    out[below] += 1
    return out


def _sized(docs: DataFrame, old_shard) -> DataFrame:
    """One small row per document; ``_salt`` tells repeated rows apart."""
    text = docs["text"].cast("string")
    crc, h = F.crc32(F.coalesce(text, F.lit(""))), F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), crc.alias("text_crc32"), h.alias("_hash"), old_shard.cast("int").alias("old_shard"))
    return rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))


def _running(total: str, keys, order):
    """Sum of ``total`` over the rows before, in the order of ``order``."""
    return F.sum(total).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(total)


def reshard(docs: DataFrame, old_shard, shards: int) -> DataFrame:
    """Place all of ``docs`` (``doc_id``, ``text``; other columns are not read) in shards ``0 .. shards - 1`` of nearly equal bytes.

    ``old_shard``: an integer column, where a document is now, from 0; a null
    place counts as 0.  Shard j of the old layout is the home of shard j of the
    new one.  A document's size is its text in UTF-8 and 16 bytes.

    Returns ``(doc_id, size, text_crc32, old_shard, shard, slot)``; ``slot``
    numbers the rows of a shard from 0 without gaps.  Null text is empty.
    Repeated rows are documents of their own.  An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    spark = docs.sparkSession
    with scratch(spark) as keep:
        rows = table(_sized(docs, F.coalesce(old_shard, F.lit(0))), "sized")
        old = rows.groupBy("old_shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SHARDS + 1).collect()
        if len(old) > MOST_SHARDS:
            raise ValueError(f"more than {MOST_SHARDS} old shards")
        if any(r["old_shard"] < 0 for r in old):
            raise ValueError("old shards are numbered from 0")
        names, total = sorted(r["old_shard"] for r in old), sum(r["size"] for r in old)
        n_rows, fine = sum(r["n"] for r in old), max(1, total // shards // FINE)

        # Large documents, fewer than FINE * (shards + 1): the same row as often as it is repeated.
        large = rows.where(F.col("size") > fine).select("doc_id", "_salt", "_hash", "old_shard", "size").orderBy("_hash", "size", "old_shard", "doc_id", "_salt").collect()
        load, mean = np.zeros(shards, np.int64), -(-total // shards)
        placed, units = [], []
        for _, equal in groupby(large, key=lambda r: (r["_hash"], r["size"], r["old_shard"])):
            equal = list(equal)
            together = sum(r["size"] for r in equal) <= mean // 8
            units += [equal] if together else [[r] for r in equal]
        for unit in sorted(units, key=lambda u: -sum(r["size"] for r in u)):
            home, size = unit[0]["old_shard"], sum(r["size"] for r in unit)
            at = home if home < shards and load[home] + size <= mean else int(load.argmin())
            load[at] += size
            placed += [(r["_salt"], r["doc_id"], at) for r in unit]
        sizes = {r["old_shard"]: r["size"] for r in old}
        supply = np.array([sizes[o] for o in names] or [0], np.int64)
        number = {o: i for i, o in enumerate(names)}
        for r in large:
            supply[number[r["old_shard"]]] -= r["size"]
        cost = np.ones((len(supply), shards))
        for i, o in enumerate(names):
            if o < shards:
                cost[i, o] = 0
        flow = transfers(supply, _filled(load, int(supply.sum())), cost)
        ranges = []
        for i, o in enumerate(names):
            to = sorted(np.flatnonzero(flow[i]).tolist(), key=lambda j: (cost[i, j], j))
            ranges.append((o, np.concatenate([[0], np.cumsum(flow[i, to])[:-1]]).astype(int).tolist() if to else [0], to or [0]))
        ways = F.broadcast(spark.createDataFrame(ranges, "old_shard int, _starts array<long>, _to array<int>"))

        small = rows.where(F.col("size") <= fine)
        buckets = max(1, min(BLOCKS, n_rows // BLOCK))
        each = max(BLOCK, n_rows // BLOCKS)
        # A block that holds one very frequent text is cut by the salt, like any other that is too large.
        small = small.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
        crowded = small.groupBy("old_shard", "_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > 2 * each)
        crowded = crowded.select("old_shard", "_bucket", F.ceil(F.col("_n") / each).alias("_cuts"))
        small = small.join(F.broadcast(crowded), ["old_shard", "_bucket"], "left")  # at most n_rows / (2 * each) rows: BLOCKS / 2
        small = small.withColumn("_cut", F.coalesce(F.pmod("_salt", F.col("_cuts")), F.lit(0))).drop("_cuts")
        block = ["old_shard", "_bucket", "_cut"]
        sums = small.groupBy(*block).agg(F.sum("size").alias("_size"))
        sums = sums.select(*block, _running("_size", ["old_shard"], ["_bucket", "_cut"]).alias("_before"))
        order = ["_hash", "doc_id", "_salt"]
        small = small.withColumn("_within", _running("size", block, order))
        same = Window.partitionBy(*block, "_hash")
        small = small.withColumn("_group", F.sum("size").over(same)).withColumn("_first", F.min("_within").over(same))
        small = small.join(sums, block).join(ways, "old_shard")
        place = F.col("_before") + F.when(F.col("_group") <= fine, F.col("_first")).otherwise(F.col("_within"))
        small = small.withColumn("shard", F.element_at("_to", F.size(F.filter("_starts", lambda s: s <= place))))
        names_out = ["doc_id", "size", "text_crc32", "old_shard", "shard", "_salt"]
        big = F.broadcast(spark.createDataFrame(placed, "_salt long, doc_id long, shard int"))
        fit = (rows["doc_id"].eqNullSafe(big["doc_id"])) & (rows["_salt"] == big["_salt"])
        apart = rows.where(F.col("size") > fine).join(big, fit).select(rows["doc_id"], "size", "text_crc32", "old_shard", "shard", rows["_salt"])
        done = table(small.select(*names_out).unionByName(apart), "placed")

        # Slots: ranks within hash blocks of a shard, and the rows of the blocks before.
        done = done.withColumn("_block", F.pmod("_salt", F.lit(buckets)))
        key = ["shard", "_block"]
        counts = done.groupBy(*key).agg(F.count("*").alias("_n")).select(*key, _running("_n", ["shard"], ["_block"]).alias("_before"))
        done = done.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy("_salt", "doc_id"))).join(counts, key)
        return keep(done.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot")), "resharded")


def rewrite(docs: DataFrame, path: str, shards: int) -> list:
    """Reshard a folder of Parquet partitions ``shard=N`` in place; returns the shards written.

    ``docs``: the rows of ``path`` as read, with its partition column ``shard``.
    Only partitions that gain or lose rows are rewritten, by dynamic partition
    overwrite; those that keep no row are deleted.  Rows that are equal in
    ``doc_id`` and text stand for each other; where a cut parts such rows, they
    go to its sides in proportion.  The new rows are in a table of their own
    before the first file of ``path`` is touched, so a run that fails before
    that can be repeated.
    """
    spark = docs.sparkSession
    with scratch(spark):
        placed = reshard(docs, docs["shard"], shards)
        touched = {r["s"] for r in placed.where("shard <> old_shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect()}
        if not touched:
            return []
        key = ["_id", "_crc", "_old"]
        named = lambda crc, old: (F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), crc.alias("_crc"), old.alias("_old"))
        here = docs["shard"].isin(*touched)
        rows = docs.where(here).select("*", *named(F.crc32(F.coalesce(docs["text"].cast("string"), F.lit(""))), F.coalesce(docs["shard"].cast("int"), F.lit(0))))
        counts = placed.groupBy(*named(F.col("text_crc32"), F.col("old_shard")), F.col("shard").alias("_to")).agg(F.count("*").alias("_n"))
        ways = counts.groupBy(*key).agg(F.collect_list(F.struct("_to", "_n")).alias("_ways"), F.sum("_n").alias("_all"))  # one entry per shard at most
        drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_all"))
        pick = F.aggregate("_ways", F.struct(drawn.alias("left"), F.lit(-1).alias("to")), lambda a, w: F.when((a["to"] < 0) & (a["left"] < w["_n"]), F.struct(a["left"].alias("left"), w["_to"].alias("to"))).otherwise(F.struct((a["left"] - F.when(a["to"] < 0, w["_n"]).otherwise(F.lit(0))).alias("left"), a["to"].alias("to"))), lambda a: a["to"])
        new = table(rows.join(ways, key).withColumn("shard", pick).select(*docs.columns), "rewritten")
        kept = {r["shard"] for r in new.select("shard").distinct().collect()}
        new.repartition("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        delete(spark, *(f"{path}/shard={s}" for s in touched - kept))
    return sorted(touched)
