"""Resharding and phrase collocations against brute force, with nulls, empty and long texts, ties, repeated rows, hot texts, empty tables and clashing columns."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import collocations, queries, sharding

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside, as further columns.
CLASH = "doc_id long, text string, lang string, size long, shard int, phrase string, n long, _salt long, slices int, old int"


def cheapest(supply, capacity, cost):
    """Least cost of any integer transport, by trying every split of each old shard."""
    best = {tuple(capacity): 0.0}
    for i, units in enumerate(supply):
        after = {}
        for room, paid in best.items():
            for split in itertools.product(range(units + 1), repeat=len(room)):
                if sum(split) == units and all(x <= y for x, y in zip(split, room, strict=True)):
                    left = tuple(y - x for x, y in zip(split, room, strict=True))
                    total = paid + sum(x * c for x, c in zip(split, cost[i], strict=True))
                    after[left] = min(after.get(left, 1e18), total)
        best = after
    return min(best.values())


def test_transfers_are_cheapest():
    rnd = random.Random(3)
    for _ in range(60):
        m, n = rnd.randint(1, 4), rnd.randint(1, 4)
        supply = [rnd.randint(0, 4) for _ in range(m)]
        cost = [[rnd.randint(0, 9) for _ in range(n)] for _ in range(m)]
        capacity = [rnd.randint(0, 6) for _ in range(n)]
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError):
                sharding.transfers(supply, capacity, cost)
            continue
        flow = sharding.transfers(supply, capacity, cost)
        assert (flow >= 0).all() and flow.sum(axis=1).tolist() == supply and (flow.sum(axis=0) <= capacity).all()
        assert float((flow * np.array(cost)).sum()) == cheapest(supply, capacity, cost)


def test_levels():
    rnd = random.Random(4)
    for _ in range(200):
        load, total = [rnd.choice([0, rnd.randint(0, 50)]) for _ in range(rnd.randint(1, 9))], rnd.randint(0, 200)
        got = sharding._filled(load, total)
        assert got.sum() == total and (got >= 0).all()
        filled = [a + b for a, b in zip(load, got, strict=True) if b]
        assert not filled or max(filled) - min([*filled, *(a for a, b in zip(load, got, strict=True) if not b)]) <= 1


def check_law(rows, docs, shards):
    """Every row once, slots gapless, bytes as near equal as documents allow."""
    size = lambda t: len((t or "").encode()) + 16
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=key) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in docs), key=key)
    by, slots = Counter(), defaultdict(list)
    for r in rows:
        by[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(by) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows:
        mean, largest = sum(by.values()) / shards, max(r["size"] for r in rows)
        assert max(by.values()) <= max(1.1 * mean, mean + 4 * largest if largest > mean / 64 else 0)
        assert min(by[j] for j in range(shards)) >= min(0.9 * mean, mean - 4 * largest)
    return by


def test_reshard(spark):
    rnd = random.Random(7)
    texts = [None, "", "é" * 30, "x" * 60_000] + [" ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 200))) for _ in range(3000)] + ["the same text"] * 1500 + ["another one"] * 40
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 700 + [(None, "no id"), (None, None)]
    frame = spark.createDataFrame([(d, t, "en", 1, zlib.crc32((t or "").encode()) % 7, "p", 2, 3, 4, 5) for d, t in docs], CLASH)
    for shards in (1, 5, 11):
        rows = sharding.reshard(frame, frame["shard"], shards).collect()
        by = check_law(rows, docs, shards)
        fine = sum(by.values()) // shards // sharding.FINE
        places = defaultdict(set)
        for r in rows:
            places[r.text_crc32].add(r.shard)
        total = Counter()
        for d, t in docs:
            total[zlib.crc32((t or "").encode())] += len((t or "").encode()) + 16
        # Equal texts stay together unless there are too many of them.
        assert all(len(places[c]) == 1 for c in total if total[c] <= fine)
        # Nothing moves that need not: no home ends above the mean by what it got from others.
        moved = sum(r["size"] for r in rows if r.shard != r.old_shard)
        old = Counter()
        for r in rows:
            old[r.old_shard] += r["size"]
        mean = sum(by.values()) / shards
        least = sum(max(0, old[o] - (mean if o < shards else 0)) for o in old)
        assert moved <= least + shards * 4 * max(fine, 1) + 60_016


def test_reshard_hot_row(spark):
    """One row repeated by a third of all is cut over shards and over blocks."""
    frame = spark.range(30_000).selectExpr("if(id % 3 = 0, 1, id) as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text", "cast(if(id % 3 = 0, 3, id % 4) as int) as shard")
    rows = sharding.reshard(frame, frame["shard"], 6).collect()
    by = check_law(rows, [(r.doc_id, r.text) for r in frame.collect()], 6)
    assert max(by.values()) - min(by.values()) < 0.02 * sum(by.values())


def test_reshard_nothing(spark):
    none = spark.createDataFrame([], CLASH)
    assert sharding.reshard(none, none["shard"], 4).count() == 0
    with pytest.raises(ValueError):
        sharding.reshard(none, none["shard"], 0)


def test_rewrite_only_what_changes(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    frame = spark.range(4000).selectExpr("id as doc_id", "repeat(cast(id as string), 20) as text", "id * 2 as other", "cast(if(id < 2500, 0, if(id < 3500, 1, 2)) as int) as shard")
    frame.unionByName(frame.where("doc_id = 7")).repartition("shard").write.partitionBy("shard").parquet(path)
    before = spark.read.parquet(path)
    files = {f.name for f in (tmp_path / "shards" / "shard=2").iterdir()}
    assert sharding.rewrite(before, path, 3) == [0, 1, 2]
    after = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text, r.other) for r in after.collect()) == sorted((r.doc_id, r.text, r.other) for r in frame.collect() + frame.where("doc_id = 7").collect())
    assert {f.name for f in (tmp_path / "shards" / "shard=2").iterdir()} != files
    sums = [r.s for r in after.groupBy("shard").agg({"text": "count"}).toDF("shard", "s").collect()]
    assert len(sums) == 3 and sharding.rewrite(spark.read.parquet(path), path, 3) in ([], [0, 1], [0, 2], [1, 2], [0, 1, 2])
    sharding.rewrite(spark.read.parquet(path), path, 2)
    assert not (tmp_path / "shards" / "shard=2").exists() and spark.read.parquet(path).count() == 4001


def test_rewrite_leaves_even_shards_alone(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    spark.range(4000).selectExpr("id as doc_id", "'same size' as text", "cast(id % 4 as int) as shard").write.partitionBy("shard").parquet(path)
    files = sorted(str(f) for f in (tmp_path / "shards").rglob("*.parquet"))
    assert sharding.rewrite(spark.read.parquet(path), path, 4) == [] and sorted(str(f) for f in (tmp_path / "shards").rglob("*.parquet")) == files


def test_op11_query(spark):
    rows = queries.QUERIES["op11_sharding"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_law(rows, [(r.doc_id, r.text) for r in docs], 40)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


# --- collocations --------------------------------------------------------------


def plain(docs, least, top):
    """The contract in plain Python."""
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in chosen.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in chosen.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rnd = random.Random(11)
    words = ["the", "Cat", "sat", "on", "a", "mat", "Éa", "日本", "x\x00y", "don't", "a\x85b", "in", "of"]
    docs = []
    for _ in range(400):
        text = "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", " ", ". ", ",", "\n", " \r\n", "\x0b", "? "]) for _ in range(rnd.randint(0, 60)))
        docs.append((text, rnd.choice(["en", "en", "fr", None, "und", ""])))
    docs += [(None, "en"), ("", "en"), (None, None), ("one two three four five six " * 40, "fr"), ("the cat the cat the cat the cat", "en")] + [("hot text of a third of all rows", "en")] * 200
    return docs + [("aa bb " * 5000 + "cc", "de"), ("...", "de"), (" \t ", "de")]


def test_phrases(spark, spoken):
    frame = spark.createDataFrame([(i, t, g, 1, 2, "p", 3, 4, 5, 6) for i, (t, g) in enumerate(spoken)], CLASH)
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for least, top, sizes in ((5, 40, {}), (2, 10_000, {"part_bits": 8, "patterns": 500}), (30, 7, {"part_bits": 11}), (1, 50, {})):
        got = collocations.collocations(frame, least, top, **sizes)
        assert got.columns == cols
        assert sorted(tuple(r) for r in got.collect()) == plain(spoken, least, top)


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], CLASH)
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "one", "en")], "doc_id long, text string, lang string"), 1).count() == 0
    with pytest.raises(ValueError):
        collocations.phrase_counts(none, 0)


def test_phrases_with_exact_arithmetic(spark):
    """Products beyond 64 bits: the last step alone, on counts as a very large corpus has them."""
    from pyspark.sql import functions as F

    a, n, left, right = 10**13 + 7, 10**15 + 3, 3 * 10**14 + 1, 2 * 10**13 + 9
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    exact = lambda c: c.cast("decimal(18,0)")
    got = row.select((exact(F.col("a") * 1000) * exact(F.col("n"))).alias("p"), (exact(F.col("l")) * exact(F.col("r"))).alias("q")).selectExpr("p div q as score").first()[0]
    assert got == 1000 * a * n // (left * right)
