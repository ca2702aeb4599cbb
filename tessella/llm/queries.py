"""The thin ``opN_*`` queries: each derives its result columns from an operator's output, over whole tables."""

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, hamming, licenses, ngram, packing, ranking, rules, secrets, sharding, warc

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), path(TOKENIZER))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    ranker = ranking.train(docs, _read(spark, sf_dir, "labels"), lambda doc_id: ~ranking.held_out(doc_id))
    scored = ranking.score_documents(docs, ranker, "doc_id")
    return scored.select("doc_id", ranking.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    read = chat.parse_conversations(chat.format_conversations(turns.unionByName(more)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_read(spark, sf_dir, "documents"), path(TOKENIZER)).withColumnRenamed("id", "doc_id")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.jaccard_components(_read(spark, sf_dir, "documents"), 4, 85, 100)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = secrets.scan_documents(docs, secrets.train(docs))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(_read(spark, sf_dir, "embeddings"))
    return hamming.top_k(codes, codes.where("id % 100 = 0"), k=10)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    learned = rules.train(docs, _read(spark, sf_dir, "labels"), lambda doc_id: ~ranking.held_out(doc_id))
    return rules.apply_rules(docs, learned, "doc_id").drop("rule")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by a hash of the text, which copies make uneven, to 40 of equal bytes."""
    docs = _read(spark, sf_dir, "documents")
    placed = sharding.reshard(docs, F.pmod(F.crc32(F.coalesce("text", F.lit(""))), F.lit(32)), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"), least=100, top=2000)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_chat_formatting, op4_bpe, op5_ngram_jaccard, op6_secret_scan, op7_warc, op8_exact_top_k, op9_quality_rules, op10_license_scan, op11_sharding, op12_phrase_collocations)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([\[<])(\\*)(/?(?:INST|SYS|ANS|ROLE|TXT|SEP)\]|/?s>)', '\1\\\2\3', 'g') AS x, regexp_replace(role, '([\[<])(\\*)(/?(?:INST|SYS|ANS|ROLE|TXT|SEP)\]|/?s>)', '\1\\\2\3', 'g') AS xr,
  coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS joined FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE WHEN joined THEN 5 WHEN role = 'user' THEN 15 WHEN role = 'system' THEN 13 WHEN role = 'assistant' THEN 11 ELSE 22 + length(xr) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, m AS component_id FROM n JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = doc_id
"""

_OP7 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND n >= 1000
"""

_OP8 = """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS c FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id, CAST(list_sum(list_transform(range(1, len(b.c) + 1), lambda i: CASE WHEN b.c[i] <> q.c[i] THEN 1 ELSE 0 END)) AS INT) AS distance FROM b JOIN b q ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INT) AS rank FROM d)
SELECT query_id, neighbor_id, distance, rank FROM r WHERE rank <= 10
"""


def _license_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {quoted(words)}, {licenses._least(words, licenses.THRESHOLD)}, {licenses._window(licenses.TEMPLATES[label], licenses.THRESHOLD)})" for label, words in licenses._template_words(licenses.TEMPLATES).items())
    phrases = ", ".join(f"('{label}', {quoted(p)})" for p, label in licenses.PHRASES.items())
    split = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH t(label, words, need, width) AS (VALUES {templates}), p(label, words) AS (VALUES {phrases}),
w AS (SELECT doc_id, {_LOW} AS low FROM documents), s AS (SELECT doc_id, low, {split.format('low')} AS w FROM w),
q AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM s),
f AS (SELECT doc_id, pos, label FROM q, p WHERE w[pos + 1] = p.words[1] AND w[pos + 1:pos + len(p.words)] = p.words),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM f GROUP BY doc_id),
k AS (SELECT label, need, width, len(words) AS size, unnest(words) AS word FROM t),
h AS (SELECT doc_id, pos, label, need, width, size, word FROM (SELECT doc_id, pos, w[pos + 1] AS word FROM q) JOIN k USING (word)),
m AS (SELECT a.doc_id, a.label, a.pos, a.need, a.size, count(DISTINCT z.word) AS o FROM h a JOIN h z ON a.doc_id = z.doc_id AND a.label = z.label AND z.pos BETWEEN a.pos AND a.pos + a.width - 1 GROUP BY ALL),
x AS (SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(o AS DOUBLE) / size) AS score FROM m WHERE o >= need GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, CAST([] AS VARCHAR[])), coalesce(x.labels, CAST([] AS VARCHAR[]))))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0e0 ELSE coalesce(x.score, 0.0e0) END AS score
FROM s LEFT JOIN b ON s.doc_id = b.doc_id LEFT JOIN x ON s.doc_id = x.doc_id
"""


_OP12 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i:i + k - 1] AS w, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) t(k)) GROUP BY ALL),
h AS (SELECT lang, w, array_to_string(w, ' ') AS phrase, f FROM g WHERE f >= 100),
c AS (SELECT * FROM h WHERE len(w) > 1),
d AS (SELECT lang, s, max(f) AS f FROM (SELECT lang, f, unnest([w[1:len(w) - 1], w[2:len(w)]]) AS s FROM c WHERE len(w) > 2) GROUP BY ALL),
k AS (SELECT c.lang, c.w, c.phrase, c.f AS a, unnest(range(1, len(c.w))) AS k FROM c LEFT JOIN d ON c.lang = d.lang AND c.w = d.s WHERE d.f IS NULL OR d.f < c.f),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, n.n, 1000::HUGEINT * k.a * n.n // (x.f::HUGEINT * y.f) AS score
  FROM k JOIN n ON n.lang = k.lang JOIN h x ON x.lang = k.lang AND x.w = k.w[1:k.k] JOIN h y ON y.lang = k.lang AND y.w = k.w[k.k + 1:len(k.w)]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b QUALIFY rank <= 2000
"""


#: Operators that SQL can express; the others are tested against brute force.
ORACLE_SQL = {"op3_chat_formatting": _OP3, "op5_ngram_jaccard": _OP5, "op7_warc": _OP7, "op8_exact_top_k": _OP8, "op10_license_scan": _license_sql(), "op12_phrase_collocations": _OP12}
