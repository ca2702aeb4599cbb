"""Statistics of whole texts, for the quality classifier and the quality rules.

Words are runs of anything but space and U+0009 to U+000D; lines are split at
``\\n``.  Null text is empty; every statistic of an empty text is 0.
"""

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

WINDOW = 8
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_UPPER, _DIGITS, _STOPS = bytes(range(65, 91)), b"0123456789", b".,;:?"
_CONTINUATION, _WIDE = bytes(range(0x80, 0xC0)), bytes(range(0x80, 0x100))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "log_words", "word_length", "symbol_share", "bang_share", "upper_share", "digit_share", "stop_share", "bar_share", "other_share",
    "wide_share", "distinct_share", "dup_line_share", "repeat_share", "line_words", "short_share", "long_share", "copies_of_top_line", "adjacent_share",
)


def _without(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list) -> int:
    """Words that lie in a WINDOW-word window found twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mixed = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for j in range(WINDOW):
        mixed ^= h[j : n - WINDOW + 1 + j]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    order = np.sort(mixed)
    twice = order[:-1][order[:-1] == order[1:]]
    if not len(twice):
        return 0
    hit = twice[np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)] == mixed
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[:-WINDOW] += hit
    cover[WINDOW:] -= hit
    return int(np.count_nonzero(cover[:-1].cumsum()))


def statistics(text: bytes) -> tuple:
    """COUNTS, then RATIOS, of a UTF-8 text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS) + (0.0,) * len(RATIOS)
    chars = len(text) - _without(text, _CONTINUATION)
    word_chars = chars - _without(text, _SPACE)
    symbols = _without(text, _SYMBOLS)
    lines = [x for x in text.split(b"\n") if not x.isspace() and x] if b"\n" in text else [text]
    kinds: dict = {}
    for x in lines:
        kinds[x] = kinds.get(x, 0) + 1
    dup_lines = len(lines) - len(kinds)
    repeated = repeated_words(words)
    upper, digits, stops, bangs, bars, wide = (_without(text, c) for c in (_UPPER, _DIGITS, _STOPS, b"!", b"|", _WIDE))
    letters = _without(text, bytes(range(97, 123))) + upper
    lengths = np.fromiter(map(len, words), np.int64, n)
    ratios = (
        np.log1p(n), word_chars / n, symbols / word_chars, bangs / n, upper / word_chars, digits / word_chars, stops / n, bars / n,
        max(0, word_chars - letters - digits - stops - symbols - bangs - wide / 2) / word_chars, wide / len(text), len(set(words)) / n, dup_lines / len(lines),
        repeated / n, np.log1p(n / len(lines)), float((lengths <= 3).mean()), float((lengths >= 14).mean()), max(kinds.values()) / len(lines),
        sum(map(eq, words, words[1:])) / n,
    )
    return (n, word_chars, symbols, dup_lines, repeated, *map(float, ratios))


def text_statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns ``carry`` of ``docs`` with COUNTS (long) and RATIOS (double) of ``text``; no shuffle.

    Names of ``carry`` must not be names of statistics.
    """
    kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATIOS)

    def run(batches):
        for batch in slices(batches, 128):
            rows = list(zip(*(statistics(t) for t in utf8(batch.column(batch.num_columns - 1))), strict=True)) or [[]] * len(kinds)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=[*batch.schema.names[:-1], *COUNTS, *RATIOS])

    kept = docs.select(*(docs[c] for c in carry))
    schema = [f"`{c}` {t}" for c, t in kept.dtypes] + [f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATIOS]
    return docs.select(*(docs[c] for c in carry), docs["text"].cast("string").alias("_text")).mapInArrow(run, ", ".join(schema))


def named_labels(labels: DataFrame, label: str, keep) -> DataFrame:
    """``(doc_id, y)`` of the ids for which ``keep(doc_id)`` holds.  Documents labelled twice take their largest label; a null label or id is no label."""
    named = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where("doc_id is not null and y is not null")
    return named.where(keep(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str, keep) -> DataFrame:
    """``(doc_id, y, RATIOS)`` of all labelled rows of ``docs`` for which ``keep(doc_id)`` holds; statistics meet their labels, texts do not move."""
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where(F.col("doc_id").isNotNull()).where(keep(F.col("doc_id")))
    return text_statistics(ids, "doc_id").select("doc_id", *RATIOS).join(named_labels(labels, label, keep), "doc_id").select("doc_id", "y", *RATIOS)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, most: int) -> DataFrame:
    """At most ``most`` labelled rows of ``docs``: ``(doc_id, y, text)``, those least by a hash of doc_id.

    ``keep``: a condition on doc_id.  Documents labelled twice take their
    largest label; a null label or id is no label.  Only ids and labels, at
    most ``most`` of them, are broadcast.
    """
    chosen = named_labels(labels, label, keep).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return text.join(F.broadcast(chosen), "doc_id")
