"""The pipeline keeps what is clean, acts on what is not, and stands odd tables."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
common = pytest.importorskip("tessella.llm.common")
rules = pytest.importorskip("tessella.llm.rules")


@pytest.fixture
def folder(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9)))
    clean = lambda: ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(6)) + "."
    junk = lambda: " ".join(word() + rnd.choice(["***", "$$$", "%%%"]) for _ in range(60))
    texts = [clean() for _ in range(60)] + [junk() for _ in range(30)]
    secret = f'{clean()} token = "{rnd.randbytes(20).hex()}" {clean()}'
    texts += [texts[0], texts[1] + " extra", secret, None, ""]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.table(stage(spark, docs, folder), f"test-{n}")
        seen[name] = docs
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert not ids["quality classifier"] & set(range(60, 90)) and set(range(60)) <= ids["quality rules"]
    assert {0, 1} <= ids["near duplicates"] and not {90, 91} & ids["near duplicates"]
    text = seen["secret scan"].where("doc_id = 92").first()
    assert "[SECRET]" in text["text"] and text["n_chars"] == len(text["text"])
    assert ids["best-fit packing"] == ids["secret scan"]
    assert corpus_pipeline.run(spark, folder).count() == seen["best-fit packing"].count()


def test_stages_equal_plain_ones(spark):
    """Each stage on what the one before kept, against plain Python over the same rows."""
    import numpy as np
    import pyarrow.parquet as pq

    ngram, packing, ranking, secrets, textstats = (pytest.importorskip(f"tessella.llm.{m}") for m in ("ngram", "packing", "ranking", "secrets", "textstats"))
    sf = "/root/testdata/sf0.001"
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stats = {r.doc_id: textstats.statistics((r.text or "").encode()) for r in docs.collect()}
    import zlib

    train = sorted(i for i in stats if i in quality and zlib.crc32(str(i).encode()) % 4 != 2)
    x, y = np.array([stats[i][len(textstats.COUNTS) :] for i in train]), np.array([quality[i] for i in train])
    ranker, learned = ranking.fit(x, y), rules.learn(x, y)

    def good(i):
        f = [v if n in ranking.PLAIN else min(v, 1) ** 0.5 for n, v in zip(textstats.RATIOS, stats[i][len(textstats.COUNTS) :], strict=True)]
        return float(np.dot(f, ranker.weights)) >= ranker.threshold

    def rejected(i):
        named, counts = dict(zip(textstats.RATIOS, stats[i][len(textstats.COUNTS) :], strict=True)), stats[i]
        return counts[0] < 20 or 100 * counts[4] > 30 * counts[0] or any(all(named[n] > c if above else named[n] <= c for n, above, c in rule) for rule in learned)

    def leaders(rows):
        sets = {r.doc_id: set(ngram.shingles((r.text or "").encode(), 5).tolist()) for r in rows}
        parent = {i: i for i in sets}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a in sorted(sets):
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
        return {find(i) for i in sets}

    rows = docs.collect()
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (lambda r: {d.doc_id for d in r if good(d.doc_id)}, lambda r: {d.doc_id for d in r if not rejected(d.doc_id)}, leaders), strict=False):
        want = plain(rows)
        docs = common.table(stage(spark, docs, sf), "plain-test")
        rows = docs.collect()
        assert {d.doc_id for d in rows} == want and len(rows) == len(want), name
    field = secrets.train(docs)
    cleaned = corpus_pipeline.secret_scan(spark, docs, sf).collect()
    assert {d.doc_id: d.text for d in cleaned} == {d.doc_id: secrets.redact(d.text, secrets.scan(d.text, field)) for d in rows}


def test_learned_rules_act_after_the_classifier(spark, folder):
    passed = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 or doc_id = 75")  # of the labelled junk one, as if the classifier had passed it
    base = rules.apply_rules(passed, [], "doc_id")
    assert base.where("doc_id = 75").first()["kept"]
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, passed, folder).collect()} == set(range(60))


def test_empty(spark, folder, tmp_path):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_repeated_and_unnamed_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 5")
    odd = docs.unionByName(docs.where("doc_id = 3")).unionByName(spark.createDataFrame([(None, "a text without an id", "en", "s", 20)], docs.schema))
    kept = corpus_pipeline.near_duplicates(spark, odd, folder)
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [0, 1, 2, 3, 4, None]


def test_texts_that_share_an_id_are_judged_apart(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 4")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = [(1, text[2]), (3, text[0] + " tail"), (None, text[1]), (None, "another text without an id"), (None, "another text without an id"), (8, ""), (8, ""), (9, None)]
    odd = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema))
    kept = corpus_pipeline.near_duplicates(spark, odd, folder)
    assert kept.columns == docs.columns
    want = [(0, text[0]), (1, text[1]), (1, text[2]), (3, text[3]), (None, "another text without an id"), (8, ""), (8, ""), (9, None)]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, want))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_scratch_tables_go(spark):
    import glob

    with common.scratch(spark) as keep:
        inner = common.table(spark.range(5), "scratch-inner")
        out = keep(inner.where("id > 2"), "scratch-kept")
    at = common.shared_dir(spark).removeprefix("file://")
    assert not glob.glob(f"{at}/tessella/scratch-inner-*") and sorted(r.id for r in out.collect()) == [3, 4]
