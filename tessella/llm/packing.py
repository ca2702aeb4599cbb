"""Best-fit packing of documents into fixed-length sequences.

1. Every document is tokenized where it stands and cut into pieces of at most
   ``capacity`` ids; a document longer than that gives whole pieces, the first
   piece taking the remainder.
2. Only the histogram of piece lengths (at most ``capacity`` rows, whatever
   the corpus) reaches the driver.  There :func:`plan` applies Martello and
   Toth's dominance reduction - it fixes, for as many copies at once as there
   are, each set that provably dominates all others holding its largest piece -
   and packs what is left best-fit, longest first.  The plan is a list of runs:
   "pieces of length L with ranks r..r+m go to sequences s..s+m at offset o".
3. Pieces are ranked within their length.  A length may hold a third of all
   pieces, so they are ranked in hash buckets of about BUCKET pieces, and the
   counts of the buckets before give the rest of the rank.
"""

import bisect
import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import PRETOKENS, SegmentTreeBPE, byte_symbols
from .common import slices, table, worker_state

CAPACITY, END_ID, BUCKET = 2048, 0, 8192


def plan(histogram: dict, capacity: int) -> list:
    """Runs ``(length, first rank, count, first sequence, offset)`` that place every piece.

    ``histogram``: length -> count, lengths from 1 to ``capacity``.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    used, runs, opened = dict.fromkeys(left, 0), [], 0

    def place(size, count, sequence, offset):
        runs.append((size, used[size], count, sequence, offset))
        used[size] += count
        left[size] -= count
        if not left[size]:
            sizes.pop(bisect.bisect_left(sizes, size))

    def smallest(n, without):
        """The n least sizes of all pieces but one of size ``without``."""
        out = []
        for s in sizes:
            out += [s] * min(n - len(out), left[s] - (s == without))
            if len(out) >= n:
                break
        return out

    def best_pair(room, without):
        """Two sizes (larger first) of the greatest sum that fits."""
        lo, hi, best = 0, len(sizes) - 1, None
        count = lambda s: left[s] - (s == without)
        while lo <= hi:
            a, b = sizes[hi], sizes[lo]
            if a + b > room or not count(a):
                hi -= 1
            elif not count(b) or (a == b and count(a) < 2):
                lo += 1
            else:
                if best is None or a + b > sum(best):
                    best = (a, b)
                lo += 1
        return best

    def between(low, high, without):
        """The two least sizes strictly between, repeats counted."""
        out = []
        for s in sizes[bisect.bisect_right(sizes, low) : bisect.bisect_left(sizes, high)]:
            out += [s] * min(2 - len(out), left[s] - (s == without))
            if len(out) == 2:
                break
        return out

    def dominating(size):
        """The partners of ``size`` in a set that dominates all others with it; None if none is proven."""
        room, least = capacity - size, smallest(3, size)
        if not least or least[0] > room:
            return ()
        k = bisect.bisect_right(sizes, room) - 1
        if sizes[k] == size and left[size] == 1:
            k -= 1
        top = sizes[k]
        if top == room or len(least) < 2 or least[0] + least[1] > room:
            return (top,)
        if len(least) > 2 and sum(least) <= room:
            return None
        pair = best_pair(room, size)
        if pair is None or top >= sum(pair):
            return (top,)
        inner = between(pair[1], pair[0], size)
        if pair[0] == top and (len(inner) < 2 or sum(inner) > room):
            return pair
        return None

    again = True
    while again:
        again = False
        for size in sizes[::-1]:
            while left[size] and (partners := dominating(size)) is not None:
                members = (size, *partners)
                times = min(left[s] // members.count(s) for s in set(members))
                offset = 0
                for s in members:
                    place(s, times, opened, offset)
                    offset += s
                opened += times
                again = True

    rooms, open_at = {}, []  # free ids -> intervals [first sequence, count]; the keys in order

    def add(room, first, count):
        if room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(open_at, room)
            rooms[room].append([first, count])

    for size in sizes[::-1]:
        while n := left[size]:
            k = bisect.bisect_left(open_at, size)
            if k < len(open_at):
                room = open_at[k]
                interval = rooms[room][-1]
                first, count = interval[0], min(n, interval[1])
                if count == interval[1]:
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        open_at.pop(k)
                else:
                    interval[0] += count
                    interval[1] -= count
                place(size, count, first, capacity - room)
                add(room - size, first, count)
            else:
                each = capacity // size
                for many, layers in ((n // each, each), (1, n % each)):
                    if many and layers:
                        for layer in range(layers):
                            place(size, many, opened, layer * size)
                        add(capacity - layers * size, opened, many)
                        opened += many
    return runs


def fast_encoder(path: str):
    """text -> ids as the tokenizer file says, special tokens included.

    A byte-level BPE file whose ids follow its merges is run by the rank
    encoder, several times as fast; any other by the tokenizers library.  The
    rank encoder's expression gives up on about a million blanks in a row; such
    a text is encoded by :class:`SegmentTreeBPE`, whose splitting has no such
    bound.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, back = spec["model"], {c: b for b, c in byte_symbols().items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    merged = [model["vocab"][pair.replace(" ", "") if isinstance(pair, str) else "".join(pair)] for pair in model.get("merges", [])]
    kind = (spec.get("pre_tokenizer") or {}).get("type"), model["type"], spec.get("normalizer")
    if kind == ("ByteLevel", "BPE", None) and merged == sorted(merged) and not spec["pre_tokenizer"]["add_prefix_space"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        coder = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=special)
        patient = []

        def encode(text):
            try:
                return coder.encode(text, allowed_special="all")
            except ValueError:
                if not patient:
                    patient.append(SegmentTreeBPE(path))
                return patient[0].encode(text)

        return encode
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: library.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: every document's ids and ``end_id``, cut.

    Null text is empty (its ids are ``end_id`` alone).  Repeated rows are
    documents of their own.
    """

    def run(batches):
        encode = worker_state(f"encoder:{tokenizer}", lambda: fast_encoder(tokenizer))
        for batch in slices(batches, 64):
            rows = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    part = ids[start:stop]
                    for column, value in zip(rows, (doc, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype("<i4") if keep_ids else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            keep = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows[:keep], kinds, strict=False)], names=list(names[:keep]))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack all of ``docs`` (``doc_id``, ``text``; other columns are not read).

    Returns the columns of :func:`pieces` with ``sequence_id`` and ``offset``.
    An empty table gives no rows.
    """
    # The salt is written with the pieces: it tells repeated rows apart, however many there are of one.
    cut = table(pieces(docs, tokenizer, capacity, end_id, keep_ids).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    buckets = max(1, sum(histogram.values()) // BUCKET)
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_salt"), F.lit(buckets)))
    keys = ["length", "_bucket"]
    before = (
        cut.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .select(*keys, (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    )
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "piece", "ids_crc32", "_salt"))).join(before, keys)
    names = [c for c in cut.columns if c not in ("_bucket", "_salt")]
    ranked = ranked.select(*names, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    first = runs[:, 0] << 44 | runs[:, 1]

    def place(batches):
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "_rank"))
            at = np.searchsorted(first, lengths << 44 | ranks, side="right") - 1
            columns = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(runs[at, 3] + ranks - runs[at, 1]), pa.array(runs[at, 4])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes[:-1])
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
