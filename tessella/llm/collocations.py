"""Phrase collocations of each language: runs of 2 to 5 words that stand together more often than their parts explain.

1. Every text is cut into pieces and words.  Bigrams are counted in a sketch of
   hashed slots (one counter each, so a slot's sum is never below the count of
   a phrase in it); its size follows the corpus.  A second sketch counts the
   longer phrases all of whose bigrams may reach the least count.
2. Phrases whose upper bounds reach the least count are the candidates; they
   and their single words become patterns of Aho-Corasick automata, one per
   language, with a blank before and after every word as the guard, so that a
   match begins and ends at a word.
3. The corpus is scanned once more; every task counts all matches, overlapping
   ones too, and the sums are the exact counts that all else is derived from.

What workers hold is bounded: the slots are gone through in parts of
PART_BITS, the patterns in groups of PATTERNS, each with scans of its own.

Null text is empty; null language is ``und``.  Repeated rows count as often as
they stand there.  An empty table gives no rows.
"""

import uuid
import zlib
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, slices, table, utf8, worker_state

LONGEST = 5
#: Slots of a slice of the sketch, of a part of it, and patterns of an automaton group at most (in the mean).
SLICE_BITS, PART_BITS, PATTERNS = 20, 30, 1_000_000
#: Hashed phrases and new candidates that a task holds before it sends them, patterns whose counts are summed together, and bytes of text cut at a time.
HELD, HELD_PHRASES, SLICE, CHUNK = 1 << 23, 100_000, 1 << 14, 1 << 21
#: A language table of more rows than this is joined like any other.
FEW = 10_000
_END = b"."
#: A word, wherever pieces end.
_RUN = r"[^\x20\x09.,;:!?\x0A-\x0D]+"


def _map() -> bytes:
    out = bytearray(range(256))
    for c in range(65, 91):
        out[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        out[c] = _END[0]
    out[9] = 32
    return bytes(out)


_MAP = _map()


def words_of(text: bytes) -> list:
    """Words of a text; the end of a piece is a word ``.``, which no word can be."""
    return text.translate(_MAP).replace(_END, b" . ").split()


def _chunks(batches):
    """``(languages, word lists)`` of about CHUNK bytes of text each."""
    langs, lists, held = [], [], 0
    for batch in slices(batches, 64):
        for lang, text in zip(utf8(batch.column(0)), utf8(batch.column(1)), strict=True):
            langs.append(lang)
            lists.append([*words_of(text), _END])
            held += len(text)
            if held >= CHUNK:
                yield langs, lists
                langs, lists, held = [], [], 0
    if lists:
        yield langs, lists


def _mixed(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(langs, lists):
    """Per length from 2 on: the hash of the phrase at every word, and whether it lies within a piece."""
    words = [w for words in lists for w in words]
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    inside = h != np.uint64(zlib.crc32(_END))
    if not inside.all():  # a word may share the hash of the end mark
        inside[[i for i in np.flatnonzero(~inside) if words[i] != _END]] = True
    own = np.repeat(np.array([zlib.crc32(x) for x in langs], np.uint64), [len(x) for x in lists]) << np.uint64(32)
    now, whole, out = h ^ own, inside, {}
    for k in range(2, LONGEST + 1):
        now, whole = _mixed(now[:-1]) + h[k - 1 :], whole[:-1] & inside[k - 1 :]
        out[k] = now, whole
    return words, out


def _slot(hashes, bits):
    return _mixed(hashes) >> np.uint64(64 - bits)


def _set(flags, slot):
    return (flags[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _possible(grams, bound):
    """Per length: at which words a phrase stands whose first bigram is in this part of the sketch and whose bigrams all may reach the least count.

    ``bound``: flags of the part, bits of all slots, the part, bits of a part.
    Slots of other parts are taken to reach it.
    """
    flags, bits, part, part_bits = bound
    hashes, whole = grams[2]
    slot = _slot(hashes, bits)
    here = (slot >> np.uint64(part_bits)) == np.uint64(part)
    may = ~here | _set(flags, (slot & np.uint64((1 << part_bits) - 1)).astype(np.int64))
    now = {2: may & here & whole}
    for k in range(3, LONGEST + 1):
        before = now[k - 1]
        now[k] = before[:-1] & may[k - 2 :] & grams[k][1]
    return now


def _sketch(texts: DataFrame, bits: int, slice_bits: int, least: int, bound=None) -> DataFrame:
    """``(slice, flags)``: one bit per slot, set where its count reaches ``least``.

    Without ``bound`` bigrams are counted, with it the longer phrases that it leaves possible.
    Counters stop at ``least`` within a task, so an entry takes 4 bytes.
    """
    held_most = HELD

    def count(batches):
        held, n = [], 0

        def flush():
            slot, times = np.unique(_slot(np.concatenate(held), bits), return_counts=True)
            entry = (slot & np.uint64((1 << slice_bits) - 1)).astype(np.uint32) << np.uint32(11) | np.minimum(times, least).astype(np.uint32)
            which = (slot >> np.uint64(slice_bits)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            blobs = [part.astype("<u4").tobytes() for part in np.split(entry, starts[1:])]
            for i in range(0, len(blobs), 32):
                yield pa.RecordBatch.from_arrays([pa.array(which[starts[i : i + 32]]), pa.array(blobs[i : i + 32], pa.binary())], names=["slice", "entries"])

        for langs, lists in _chunks(batches):
            _, grams = _hashes(langs, lists)
            if bound is None:
                hashes, whole = grams[2]
                found = [hashes[whole]]
            else:
                possible = _possible(grams, bound.value)
                found = [grams[k][0][possible[k]] for k in range(3, LONGEST + 1)]
            held += found
            n += sum(map(len, found))
            if n >= held_most:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def add(group: pa.Table) -> pa.Table:
        sums = np.zeros(1 << slice_bits, np.int64)
        for blob in group.column("entries"):
            entry = np.frombuffer(blob.as_py(), "<u4")
            sums[entry >> 11] += entry & 2047  # slots of one blob are distinct
        flags = np.packbits(sums >= least, bitorder="little")
        return pa.table({"slice": pa.array([group.column("slice")[0].as_py()], pa.int64()), "flags": pa.array([flags.tobytes()], pa.binary())})

    return texts.mapInArrow(count, "slice long, entries binary").groupBy("slice").applyInArrow(add, "slice long, flags binary")


def _flags(sketch: DataFrame, bits: int, slice_bits: int, first: int = 0) -> np.ndarray:
    """The flags of ``2 ** bits`` slots from slice ``first`` on: 2 ** (bits - 3) bytes, whatever the corpus."""
    size = 1 << slice_bits >> 3
    out = np.zeros(1 << bits >> 3, np.uint8)
    n = 1 << (bits - slice_bits)
    for row in sketch.where(F.col("slice").between(first, first + n - 1)).toLocalIterator():
        at = (row["slice"] - first) * size
        out[at : at + size] = np.frombuffer(row["flags"], np.uint8)
    return out


def _candidates(texts: DataFrame, bound, longer, longer_bits: int, buckets: int) -> DataFrame:
    """Distinct ``(lang, phrase)`` whose upper bounds reach the least count, with the words that they are made of.

    A task sends what it has not sent before, as one row per bucket of phrases;
    what tasks send is at most what stands in their texts.
    """

    def run(batches):
        seen: set = set()

        def packed(new):
            rows: dict = {}
            for pair in new:
                rows.setdefault(zlib.crc32(pair[1]) % buckets, []).append(pair)
            lists = lambda k: pa.array([[p[k] for p in v] for v in rows.values()], pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), lists(0), lists(1)], names=["bucket", "langs", "phrases"])

        fresh: set = set()
        for langs, lists in _chunks(batches):
            words, grams = _hashes(langs, lists)
            ends = np.cumsum([len(x) for x in lists])
            possible, flags = _possible(grams, bound.value), longer.value
            for k, mask in possible.items():
                at = np.flatnonzero(mask)
                hashes = grams[k][0][at]
                if k > 2:
                    slot = _slot(hashes, longer_bits).astype(np.int64)
                    keep = _set(flags, slot)
                    at, hashes = at[keep], hashes[keep]
                _, first = np.unique(hashes, return_index=True)
                at = at[first]
                for i, doc in zip(at.tolist(), np.searchsorted(ends, at, side="right").tolist(), strict=True):
                    pair = langs[doc], b" ".join(words[i : i + k])
                    if pair not in seen:
                        seen.add(pair)
                        fresh.add(pair)
                        fresh.update((langs[doc], w) for w in words[i : i + k])
            if len(fresh) > HELD_PHRASES:
                yield packed(fresh)
                fresh = set()
            if len(seen) > PATTERNS:
                seen = set()
        if fresh:
            yield packed(fresh)

    def distinct(group: pa.Table) -> pa.Table:
        pairs = {p for langs, phrases in zip(group.column("langs").to_pylist(), group.column("phrases").to_pylist(), strict=True) for p in zip(langs, phrases, strict=True)}
        columns = list(zip(*pairs, strict=True))
        return pa.table({"lang": pa.array(columns[0], pa.binary()), "phrase": pa.array(columns[1], pa.binary())})

    return texts.mapInArrow(run, "bucket long, langs array<binary>, phrases array<binary>").groupBy("bucket").applyInArrow(distinct, "lang binary, phrase binary")


def _automata(patterns) -> dict:
    """lang -> automaton over `` word word ``; a match gives the place of its pattern in ``patterns``."""
    out: dict = {}
    for i, (lang, phrase) in enumerate(patterns):
        if lang not in out:
            out[lang] = ahocorasick.Automaton()
        out[lang].add_word(f" {phrase.decode(errors='surrogateescape')} ", i)
    for automaton in out.values():
        automaton.make_automaton()
    return out


def _counts(texts: DataFrame, patterns, key: str) -> DataFrame:
    """``(lang, phrase, n)`` for one group of patterns: every task counts all of them, the counts of a slice of patterns are summed together."""

    def run(batches):
        group = patterns.value
        state = worker_state("collocations", dict)
        if key not in state:
            state.clear()  # one group at a time
            state[key] = _automata(group)
        automata = state[key]
        sums = np.zeros(len(group), np.int64)
        for langs, lists in _chunks(batches):
            joined: dict = {}
            for lang, tokens in zip(langs, lists, strict=True):
                if lang in automata:
                    joined.setdefault(lang, []).extend(tokens)
            for lang, tokens in joined.items():
                text = b" ".join([b"", *tokens, b""]).decode(errors="surrogateescape")
                found = Counter(map(itemgetter(1), automata[lang].iter(text)))
                sums[list(found)] += np.fromiter(found.values(), np.int64, len(found))
        for first in range(0, len(sums), SLICE):
            part = sums[first : first + SLICE]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([first // SLICE]), pa.array([at.astype("<u4").tobytes()]), pa.array([part[at].astype("<i8").tobytes()])], names=["slice", "at", "n"])

    def add(group: pa.Table) -> pa.Table:
        sums = np.zeros(SLICE, np.int64)
        for at, n in zip(group.column("at"), group.column("n"), strict=True):
            sums[np.frombuffer(at.as_py(), "<u4")] += np.frombuffer(n.as_py(), "<i8")  # places of one row are distinct
        at = np.flatnonzero(sums)
        first, named = group.column("slice")[0].as_py() * SLICE, patterns.value
        langs, phrases = ([named[first + i][k] for i in at] for k in (0, 1))
        return pa.table({"lang": pa.array(langs, pa.binary()), "phrase": pa.array(phrases, pa.binary()), "n": pa.array(sums[at])})

    return texts.mapInArrow(run, "slice long, at binary, n binary").groupBy("slice").applyInArrow(add, "lang binary, phrase binary, n long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))


def phrase_counts(docs: DataFrame, least: int = 100, part_bits: int = PART_BITS, patterns: int = PATTERNS) -> DataFrame:
    """``(lang, phrase, n)``: exact counts of every phrase of 2 to LONGEST words that stands ``least`` times or more in its language, of their words, and of the empty phrase, which counts all words.

    Phrases that only seemed to reach ``least`` are in the result too.  Phrases
    are words joined by a blank; ``docs`` needs ``lang`` and ``text``.
    """
    if not 1 <= least <= 2047:
        raise ValueError("least must be from 1 to 2047")
    if part_bits < 3:
        raise ValueError("part_bits must be 3 at least")
    spark, texts = docs.sparkSession, _texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(min(SLICE_BITS, part_bits), (size // 48).bit_length())
    part_bits = min(bits, part_bits)
    slice_bits = min(SLICE_BITS, part_bits)
    send, parts = spark.sparkContext.broadcast, 1 << (bits - part_bits)
    bigrams = table(_sketch(texts, bits, slice_bits, least), "bigram-sketch")
    found = None
    for part in range(parts):
        bound = send((_flags(bigrams, part_bits, slice_bits, part << (part_bits - slice_bits)), bits, part, part_bits))
        longer = send(_flags(table(_sketch(texts, part_bits, slice_bits, least, bound), "phrase-sketch"), part_bits, slice_bits))
        one = table(_candidates(texts, bound, longer, part_bits, max(16, size >> 24)), "phrase-candidates")
        found = one if found is None else found.unionByName(one)
        # The candidates are a table now: nothing recomputes what read these.
        bound.destroy()
        longer.destroy()
    if parts > 1:
        found = table(found.distinct(), "phrase-candidates")
    groups = max(1, -(-found.count() // patterns))
    counts = None
    for group in range(groups):
        rows = found.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(groups)) == group).toArrow()
        sent = send(list(zip(*(rows.column(c).to_pylist() for c in ("lang", "phrase")), strict=True)))
        one = table(_counts(texts, sent, uuid.uuid4().hex), "phrase-counts")
        sent.destroy()
        counts = one if counts is None else counts.unionByName(one)
    words = texts.groupBy(F.col("lang").cast("binary").alias("lang")).agg(F.sum(F.regexp_count("text", F.lit(_RUN))).alias("n")).where("n > 0").select("lang", F.lit(b"").alias("phrase"), "n")
    return counts.unionByName(words).select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "n")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, **sizes) -> DataFrame:
    """The ``top`` collocations of each language.

    A phrase that stands ``least`` times is cut after its first k words into
    parts that stand l and r times; its score is the least ``floor(1000 a n /
    (l r))`` of its cuts (ties to the smallest k), with a its own count and n
    all words of the language.  A phrase within a longer one of the same count
    is dropped; as counts only fall with length, phrases one word longer tell.

    Ranked by score, count (both descending) and phrase in UTF-8 byte order.
    """
    with scratch(docs.sparkSession) as keep:
        counts = keep(phrase_counts(docs, least, **sizes), "phrase-sums")
    words = F.split("phrase", " ")
    total = counts.where("phrase = ''").select("lang", F.col("n").alias("_n"))
    if total.limit(FEW + 1).count() <= FEW:
        total = F.broadcast(total)
    candidates = counts.where((F.col("n") >= least) & (F.instr("phrase", " ") > 0)).select("lang", "phrase", F.col("n").alias("a"), words.alias("_words"))
    size = F.size("_words")
    join = lambda first, count: F.array_join(F.slice("_words", first, count), " ")
    around = candidates.where(size > 2).select("lang", "a", F.explode(F.array(join(F.lit(1), size - 1), join(F.lit(2), size - 1))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = candidates.join(around, ["lang", "phrase"], "left").where("_longer is null or _longer < a").drop("_longer")
    cuts = kept.withColumn("_k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "_k", join(F.lit(1), F.col("_k")).alias("_left"), join(F.col("_k") + 1, size - F.col("_k")).alias("_right"))
    side = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"]).join(total, "lang")
    exact = lambda c: c.cast("decimal(18,0)")
    cuts = cuts.withColumn("_product", exact(F.col("a") * 1000) * exact(F.col("_n"))).withColumn("_parts", exact(F.col("l")) * exact(F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("_product div _parts").alias("score"), "_k", "l", "r", F.col("_n").alias("n"))).alias("_best"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("_best.score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", *(F.col(f"_best.{c}").cast("long").alias(c) for c in ("l", "r", "n", "score")))
