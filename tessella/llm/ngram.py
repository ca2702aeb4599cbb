"""Exact n-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its distinct k-word shingles (64-bit mixes of 64-bit
word hashes).  Documents link when ``den * |x & y| >= num * |x | y|``.

1. *Inverted index, counted exactly.*  Each task sorts the shingles of about
   CHUNK tokens and deals them by hash range, as packed arrays, to ``parts``
   index parts.  A part counts each shingle over the whole corpus and sends
   back only those found in two documents or more.  A shingle that stands in
   more than HOT documents of a chunk is counted there: its part is told the
   count alone and its documents stay with the chunk, so a passage that a third
   of the corpus shares costs its part a number for each chunk.  A link needs an overlap
   of ``num/den`` of either set, so a document with fewer shared shingles has
   none and leaves the search, whatever its size.
2. *Short lists.*  Under one global order (frequency, then hash) two linked
   documents share one of their ``n - T + 1`` rarest shingles, T being the
   least overlap that any partner needs.  Those lists are short; they name the
   candidates.  A pair must also fit by length and by bitmap: each set is a
   bitmap of WORDS_ * 64 bits, a token flipping its bit, and the differing bits
   never exceed the symmetric difference that a link allows.  In each list a
   few pivots are tried with all members first, and what they link is merged
   (:mod:`graph`); after that only members of *different* components are
   paired, so a group of copies costs a multiple of its size, not its square.
   Every fitting pair between components is still tried.
3. *DivideSkip.*  A query and a block of its candidates: inverted lists over
   the block, the longest set aside, the short ones heap-merged, and what
   occurs often enough in them binary-probed in the long ones.  Those that
   reach the required overlap are links.

Identical sets are one class from the start.  Documents without a word (null,
empty, blank) have no set and link with nothing.  Repeated rows are copies.

Shingles are compared by hash: 64 bits for the set's size, BITS of them in the
index.  Two different sets of n shingles share a foreign token by chance with
about ``n * n / 2**BITS`` (for 1,000 shingles, 4e-9), whatever the size of the
corpus; a token that only seems shared elsewhere prunes less, and no link is lost.
"""

import bisect
import heapq
import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, scratch, slices, table, utf8
from .graph import components

#: Shingles that a task sorts at once, which an index part holds on average as well: at least, and at most on a large corpus (:func:`_spread`).
CHUNK, MOST_CHUNK = 1_000_000, 2_000_000
#: Candidates in a block; rows of a list that a task joins.
BLOCK, SALTED = 64, 512
#: A class in more pairs than HUB is spread over SPREAD tasks where pairs meet its row.
HUB, SPREAD = 20_000, 64
#: Documents of a chunk whose shingle is dealt posting by posting, at most.
HOT = 8
#: Tokens keep so many bits of the shingle's hash.
BITS = 48
#: 64-bit words of a set's bitmap; pivots of a list in a round of stars are the least and greatest by so many hashes; rounds at most.
WORDS_, SEEDS, ROUNDS = 8, 4, 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of UTF-8 text, A-Z lower-cased; fewer words are one shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    width = min(k, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out ^= h[j : n - width + 1 + j] * _ODD[j % 8]
        out *= _ODD[(j + 3) % 8]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def least_overlap(n: int, num: int, den: int) -> int:
    """What a set of n shares at least with any partner."""
    return -(-num * n // den)


def needed(a: int, b: int, num: int, den: int) -> int:
    """The least i with ``den * i >= num * (a + b - i)``."""
    return -(-num * (a + b) // (num + den))


def _pack(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a.astype(kind)).tobytes()


def _spread(chars: int) -> tuple:
    """Shingles of a chunk, and the number of index parts, for a corpus of so many characters.

    A chunk sends a row to each part that it has shingles of, so both grow with
    the square root of the corpus (within memory) to keep rows long.
    """
    tokens = max(1, chars // 6)
    size = max(CHUNK, min(MOST_CHUNK, math.isqrt(100 * tokens)))
    return size, max(4, -(-tokens // size))


# A row without a head holds postings; with an empty one, tokens and counts of hot shingles; else a chunk's documents and hot postings.
_FLOW = "part int, chunk long, base long, body binary, extra binary, head binary"
_FLOW_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_FLOW_NAMES = ["part", "chunk", "base", "body", "extra", "head"]


def _emit(rows: list):
    columns = zip(*rows, strict=True) if rows else [[]] * len(_FLOW_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _FLOW_KINDS, strict=True)], names=_FLOW_NAMES)


def _deal(k: int, parts: int, size: int):
    """Documents -> packed postings by index part, and one head for each chunk."""

    def run(batches):
        from pyspark import TaskContext

        base, seq, sets, ids, marks, keys = TaskContext.get().partitionId() << 24, 0, [], [], [], []
        held = 0
        for batch in slices(batches, 128):
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                s = shingles(text, k)
                sets.append(s)
                ids.append(doc)
                marks.append(mark)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"")
                held += len(s)
                if held >= size or len(ids) >= 60_000:
                    yield from _chunk(base + seq, sets, ids, marks, keys, parts)
                    seq, sets, ids, marks, keys, held = seq + 1, [], [], [], [], 0
        if ids:
            yield from _chunk(base + seq, sets, ids, marks, keys, parts)

    return run


def _part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The index part of each token: equal ranges of their upper 32 bits."""
    return ((tokens >> np.uint64(BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, dtype=np.int64)


def _sliced(data: np.ndarray, kind: str, starts: np.ndarray) -> pa.Array:
    """One binary value for each run of ``data``, all in one buffer."""
    offsets = np.append(starts, len(data)) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(_pack(data, kind))])


def _postings(chunk: int, tokens: np.ndarray, owner: np.ndarray, parts: int):
    """Sorted tokens with their owners as one row for each part, however many parts there are; those with a gap of over 32 bits apart."""
    part = _part_of(tokens, parts)
    at = _starts(part)
    gaps = np.diff(tokens, prepend=tokens[:1])
    gaps[at] = 0
    wide = np.repeat(np.maximum.reduceat(gaps, at) >= 1 << 32, np.diff(np.append(at, len(tokens))))
    for kind, chosen in (("<u4", ~wide), ("<u8", wide)):
        if chosen.any():
            t, p = tokens[chosen], part[chosen]
            at = _starts(p)
            columns = [
                pa.array(p[at].astype(np.int32)), pa.array(np.full(len(at), chunk)), pa.array(t[at].astype(np.int64)),
                _sliced(gaps[chosen], kind, at), _sliced(owner[chosen], "<u2", at), pa.nulls(len(at), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_FLOW_NAMES)


def _gap_kind(gaps: np.ndarray) -> str:
    return "<u4" if not len(gaps) or gaps.max() < 1 << 32 else "<u8"


def _tokens(base: int, body: bytes, owners: int) -> np.ndarray:
    """Tokens from the first and the gaps, which take 4 or 8 bytes each."""
    gaps = np.frombuffer(body, dtype=f"<u{len(body) // owners}").astype(np.uint64)
    gaps[0] = base
    return gaps.cumsum(dtype=np.uint64)


def _chunk(chunk: int, sets: list, ids: list, marks: list, keys: list, parts: int):
    n = np.array([len(s) for s in sets], dtype=np.int64)
    first, seen = np.zeros(len(ids), dtype=bool), set()
    for i, key in enumerate(keys):
        if key and key not in seen:
            first[i] = True
            seen.add(key)
    docs = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(n), pa.array([x or None for x in keys], pa.binary())], names=["doc_id", "h", "n", "key"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_batch(docs)
    hot_lists = (None, None)
    kept = np.flatnonzero(first)
    if len(kept):
        tokens = np.concatenate([sets[i] for i in kept]) >> np.uint64(64 - BITS)
        owner = np.repeat(kept, n[kept]).astype(np.uint16)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = _starts(tokens)
        times = np.diff(np.append(new, len(tokens)))
        if (hot := times > HOT).any():
            held, local, mine = tokens[new[hot]], times[hot], np.repeat(hot, times)
            hot_lists = (_pack(held, "<u8"), _pack(local, "<u2") + _pack(owner[mine], "<u2"))
            part = _part_of(held, parts)
            cuts = np.append(_starts(part), len(part))
            yield _emit([(int(part[lo]), chunk, 0, _pack(held[lo:hi], "<u8"), _pack(local[lo:hi], "<u2"), b"") for lo, hi in pairwise(cuts)])
            tokens, owner = tokens[~mine], owner[~mine]
        if len(tokens):
            yield from _postings(chunk, tokens, owner, parts)
    yield _emit([(chunk % parts, chunk, 0, *hot_lists, sink.getvalue().to_pybytes())])


def _count(group: pa.Table) -> pa.Table:
    """One index part: count its shingles, return the shared ones to their chunks."""
    part, names = group.column("part")[0].as_py(), _FLOW_NAMES[1:]
    found = list(zip(*(group.column(c).to_pylist() for c in names), strict=True))
    rows = [(part, *row) for row in found if row[4]]
    lists = [(c, _tokens(at, b, len(e) // 2), e) for c, at, b, e, h in found if h is None]
    told = [(c, np.frombuffer(b, dtype="<u8"), np.frombuffer(e, dtype="<u2")) for c, _, b, e, h in found if h == b""]
    if lists or told:
        every = np.concatenate([np.empty(0, dtype=np.uint64), *(t for _, t, _ in lists)])
        every.sort()
        new = _starts(every)
        counts, values = np.diff(np.append(new, len(every))), every[new]
        if told:
            hot, which = np.unique(np.concatenate([t for _, t, _ in told]), return_inverse=True)
            times = np.bincount(which, weights=np.concatenate([n for _, _, n in told])).astype(np.int64)
            at = np.searchsorted(values, hot)
            old = at < len(values)
            old[old] = values[at[old]] == hot[old]
            counts[at[old]] += times[old]
            values, counts = np.insert(values, at[~old], hot[~old]), np.insert(counts, at[~old], times[~old])
        shared = counts > 1
        values, counts = values[shared], np.minimum(counts[shared], 65535)
        rows += [(part, c, 0, _pack(t, "<u8"), _pack(counts[np.searchsorted(values, t)], "<u2"), b"") for c, t, _ in told]
        for chunk, tokens, extra in lists:
            if not len(values):
                break
            at = np.minimum(np.searchsorted(values, tokens), len(values) - 1)
            hit = values[at] == tokens
            if hit.any():
                tokens, owner = tokens[hit], np.frombuffer(extra, dtype="<u2")[hit]
                gaps = np.diff(tokens, prepend=tokens[:1])
                rows.append((part, chunk, int(tokens[0]), _pack(gaps, _gap_kind(gaps)), _pack(owner, "<u2") + _pack(counts[at[hit]], "<u2"), None))
    release()
    return pa.Table.from_batches([_emit(rows)])


_DOCS = "docs array<struct<doc_id:long,h:long>>, n long, key binary, tokens binary"


def _gather(num: int, den: int):
    """One chunk: a row for each set with its documents, and shared shingles (rarest first) where there are enough for a link.

    Copies stay together, so a text that a third of the corpus repeats is one
    row of each chunk in what follows.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("base", "body", "extra", "head")), strict=True))
        _, held, hot_lists, head = next(row for row in rows if row[3])
        docs = pa.ipc.open_stream(head).read_all()
        n = docs.column("n").to_numpy()
        out = [None] * len(n)
        parts = [(_tokens(at, b, len(e) // 4), np.frombuffer(e, dtype="<u2").reshape(2, -1)) for at, b, e, h in rows if h is None]
        if held:
            tokens, lists = np.frombuffer(held, dtype="<u8"), np.frombuffer(hot_lists, dtype="<u2")
            told = [(np.frombuffer(b, dtype="<u8"), np.frombuffer(e, dtype="<u2")) for _, b, e, h in rows if h == b""]
            order = np.argsort(np.concatenate([t for t, _ in told]))  # the same tokens, by part
            counts, local = np.concatenate([c for _, c in told])[order], lists[: len(tokens)]
            parts.append((np.repeat(tokens, local), np.stack([lists[len(tokens) :], np.repeat(counts, local)])))
        if parts:
            tokens, owner = np.concatenate([t for t, _ in parts]), np.concatenate([e[0] for _, e in parts])
            count = np.concatenate([e[1] for _, e in parts])
            order = np.lexsort((tokens, count, owner))
            tokens, owner = tokens[order], owner[order]
            at = np.searchsorted(owner, np.arange(len(n) + 1))
            for i in np.flatnonzero(np.diff(at)):
                if at[i + 1] - at[i] >= least_overlap(int(n[i]), num, den):
                    out[i] = tokens[at[i] : at[i + 1]].tobytes()
        key = docs.column("key").to_pylist()
        numbers: dict = {}
        of = np.array([numbers.setdefault(x, len(numbers)) for x in key])
        order = np.argsort(of, kind="stable")
        at = np.searchsorted(of[order], np.arange(len(numbers) + 1))
        first = order[at[:-1]]  # the document whose shingles were dealt
        copies = pa.StructArray.from_arrays([docs.column(c).combine_chunks().take(pa.array(order)) for c in ("doc_id", "h")], names=["doc_id", "h"])
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), copies)
        release()
        return pa.table({"docs": lists, "n": pa.array(n[first]), "key": pa.array(list(numbers), pa.binary()), "tokens": pa.array([out[i] for i in first], pa.binary())})

    return run


_LISTS = f"token long, rep long, s struct<n:long,u:long,{','.join(f'b{i}:long' for i in range(WORDS_))}>"


def _short_lists(num: int, den: int):
    """Classes -> (token, rep, s) of the rarest tokens; s: set size, unshared shingles, bitmap."""

    def run(batches):
        for batch in batches:
            tokens, reps, sizes = [], [], []
            for rep, n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = np.frombuffer(body, dtype="<u8")
                alone = n - len(t)
                # the shingles of this document alone come first in the order
                short = t[: max(0, n - least_overlap(n, num, den) + 1 - alone)]
                bits = np.bincount(((t * _ODD[0]) >> np.uint64(55)).astype(np.int64) % (64 * WORDS_), minlength=64 * WORDS_) & 1
                words = np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")
                tokens.append(short.astype(np.int64))
                reps.append(np.full(len(short), rep, dtype=np.int64))
                sizes.append(np.tile(np.array([n, alone, *words], dtype=np.int64), (len(short), 1)))
            if tokens:
                size = np.concatenate(sizes)
                names = ["n", "u", *(f"b{i}" for i in range(WORDS_))]
                s = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(size[:, i])) for i in range(size.shape[1])], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(reps)), s], names=["token", "rep", "s"])

    return run


def _fits(a: str, b: str, num: int, den: int) -> str:
    """What two linked sets satisfy: lengths, and differing bits against the symmetric difference allowed."""
    differ = " + ".join(f"bit_count({a}.b{i} ^ {b}.b{i})" for i in range(WORDS_))
    allowed = f"{a}.n + {b}.n - 2 * (({num} * ({a}.n + {b}.n) + {num + den - 1}) div {num + den})"
    return f"{a}.n * {den} >= {b}.n * {num} and {b}.n * {den} >= {a}.n * {num} and {a}.u + {b}.u + {differ} <= {allowed}"


def divide_skip(lists: list, required: dict, mu: float = 0.0085) -> dict:
    """Ids in at least ``required[id]`` of the sorted ``lists``, with their counts."""
    if not lists or not required:
        return {}
    t = min(required.values())
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < t:
        return {}
    longest = len(lists[-1])
    n_long = max(0, min(int(t / (mu * math.log2(max(2, longest)) + 1)), t - 1))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found = {}
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        top, count = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, k, i = heap[0]
            count += 1
            if i + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][i + 1], k, i + 1))
            else:
                heapq.heappop(heap)
        want = required[top]
        if count < want - n_long:
            continue
        for rest, x in enumerate(long):
            if count + n_long - rest < want:
                break
            i = bisect.bisect_left(x, top)
            count += i < len(x) and x[i] == top
        if count >= want:
            found[top] = count
    return found


def _search(num: int, den: int):
    """A query (the row without ``other``) against one block of candidates."""

    def run(group: pa.Table) -> pa.Table:
        query, others = group.column("query")[0].as_py(), group.column("other").to_pylist()
        sizes, bodies = group.column("n").to_pylist(), group.column("tokens").to_pylist()
        me = others.index(None)
        mine = np.sort(np.frombuffer(bodies[me], dtype="<u8"))
        block = sorted({(o, n, b) for o, n, b in zip(others, sizes, bodies, strict=True) if o is not None})
        places, who = [], []
        for i, (_, _, body) in enumerate(block):
            t = np.frombuffer(body, dtype="<u8")
            at = np.minimum(np.searchsorted(mine, t), len(mine) - 1)
            hit = at[mine[at] == t]
            places.append(hit)
            who.append(np.full(len(hit), i))
        places, who = np.concatenate(places), np.concatenate(who)
        order = np.lexsort((who, places))
        places, who = places[order], who[order]
        cuts = np.flatnonzero(np.diff(places)) + 1
        lists = [x.tolist() for x in np.split(who, cuts)] if len(who) else []
        found = divide_skip(lists, {i: needed(sizes[me], n, num, den) for i, (_, n, _) in enumerate(block)})
        return pa.table({"a": pa.array([query] * len(found), pa.int64()), "b": pa.array([block[i][0] for i in found], pa.int64())})

    return run


def _met_by(rows: DataFrame, key: str, by: str, one: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``rows`` with the row of ``one`` that has their ``key``; a hub's rows meet copies of it in SPREAD tasks, by a hash of ``by``."""
    if hubs is None:
        return rows.join(one, key)
    hubs, parts = hubs.select(F.col("node").alias(key)), F.sequence(F.lit(0), F.lit(SPREAD - 1))
    part = F.pmod(F.xxhash64(by, F.lit(-2)), F.lit(SPREAD)).cast("int")
    # whether a row's key is a hub is asked by parts too, so no task gets all rows of one
    marks = hubs.select(key, F.explode(parts).alias("_part"), F.lit(True).alias("_hub"))
    marked = rows.withColumn("_part", part).join(marks, [key, "_part"], "left").withColumn("_part", F.when(F.col("_hub"), F.col("_part")).otherwise(0)).drop("_hub")
    copies = one.join(hubs.withColumn("_hub", F.lit(True)), key, "left").withColumn("_part", F.explode(F.when(F.col("_hub"), parts).otherwise(F.array(F.lit(0))))).drop("_hub")
    return marked.join(copies, [key, "_part"]).drop("_part")


def _hubs(pairs: DataFrame) -> dict:
    """side -> the classes that more than HUB pairs have on that side; sides without one are left out.  One for every HUB pairs at most."""
    sides = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("node")) for c in ("query", "other"))))
    found = table(pairs.select(sides.alias("s")).select("s.*").groupBy("side", "node").agg(F.count("*").alias("m")).where(F.col("m") > HUB), "hubs")
    return {r["side"]: found.where(F.col("side") == r["side"]) for r in found.select("side").distinct().collect()}


def _links(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (query, other) that link, written out."""
    hubs = _hubs(pairs)
    queries, others = hubs.get("query"), hubs.get("other")
    salt = F.pmod(F.xxhash64("other"), F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK))).alias("salt")
    sized = _met_by(pairs, "query", "other", pairs.groupBy("query").agg(F.count("*").alias("m")), queries).select("query", "other", salt)
    sized = table(sized, "pairs")
    theirs = _met_by(sized, "other", "query", classes.withColumnRenamed("rep", "other"), others).select("query", "salt", "other", "n", "tokens")
    own = _met_by(sized.select("query", "salt").distinct(), "query", "salt", classes.withColumnRenamed("rep", "query"), queries)
    own = own.select("query", "salt", F.lit(None).cast("long").alias("other"), "n", "tokens")
    return table(theirs.unionByName(own).groupBy("query", "salt").applyInArrow(_search(num, den), "a long, b long"), "links")


def _apart(lists: DataFrame, joined: DataFrame | None):
    """The lists that hold two components, and per list its rows, its largest component and that one's rows.

    ``salts``: over how many tasks a list is spread when it is joined.
    """
    if joined is None:
        lists = lists.withColumn("component", F.col("rep"))
    else:
        lists = lists.drop("component").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    held = lists.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token")
    held = held.agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("total"), F.count("*").alias("k")).where("k > 1")
    held = table(held.select("token", F.col("m.component").alias("major"), F.col("m.c").alias("most"), "total", F.ceil(F.col("total") / SALTED).alias("salts")), "held")
    return table(lists.drop("salts").join(held.select("token", "salts"), "token"), "lists-apart"), held


def _met(lists: DataFrame, tried: DataFrame) -> DataFrame:
    """Rows of lists with the few rows (``token``, ``salts``, ...) that each is tried with, a long list in several tasks."""
    spread = tried.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return lists.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(-1)), "salts")).join(spread, ["token", "salt"])


def _both(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    now = pairs.unionByName(pairs.select(F.col("other").alias("query"), F.col("query").alias("other")))
    return table(now if tried is None else tried.unionByName(now), "tried")


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    pairs = pairs if tried is None else pairs.join(tried, ["query", "other"], "left_anti")
    return table(pairs, "candidates")


def linked_rows(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``(doc_id, h, n_shingles, first)`` for every row of ``docs`` (``doc_id``, ``text``).

    ``h`` is xxhash64 of the text, so that (``doc_id``, ``h``) names a row's id
    and text.  ``first`` is ``struct<unnamed, doc_id, h>``: the least id (null
    last), then the least hash, of all rows reachable by links; null for a row
    without a word, which links with nothing.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    size, parts = _spread(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    with scratch(spark) as keep:
        flow = docs.mapInArrow(_deal(k, parts, size), _FLOW)
        counted = flow.groupBy("part").applyInArrow(_count, _FLOW)
        sets = table(counted.groupBy("chunk").applyInArrow(_gather(num, den), _DOCS), "sets")
        # a class is a set, not an id: rows of one id may have different texts
        classes = sets.where("tokens is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        classes = table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
        label = table(components(_all_links(classes, num, den)), "components-all")
        row = F.array_min(F.transform("docs", lambda d: F.struct(d["doc_id"].isNull().alias("unnamed"), d["doc_id"].alias("doc_id"), d["h"].alias("h"))))
        firsts = table(sets.where("key is not null").groupBy("key").agg(F.min(row).alias("first")), "firsts")
        linked = table(classes.select("key", F.col("rep").alias("node")).join(label, "node").join(firsts, "key").select("key", "component", "first"), "linked")
        best = linked.groupBy("component").agg(F.min("first").alias("best"))
        best = linked.join(best, "component").select("key", "best")
        best = table(firsts.join(best, "key", "left").select("key", F.coalesce("best", "first").alias("first")), "best")
        out = sets.select("docs", F.col("n").alias("n_shingles"), "key").join(best, "key", "left")
        out = out.select("n_shingles", "first", F.explode("docs").alias("d"))
        return keep(out.select("d.doc_id", "d.h", "n_shingles", "first"), "linked-rows")


def _all_links(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` of ``classes`` (``rep``, ``n``, ``tokens``) enough to join all that are linked."""
    lists = table(classes.select("rep", "n", "tokens").mapInArrow(_short_lists(num, den), _LISTS), "lists")

    # stars: a few pivots of each list with all its members, then with what is still apart
    classes_n, tried, near, first = classes.count(), None, None, 0
    lists, held = _apart(lists, None)
    for turn in range(ROUNDS):
        order = [F.struct(F.xxhash64("rep", F.lit(turn * SEEDS + i)).alias("h"), "rep", "s", "component") for i in range(SEEDS)]
        pivots = lists.groupBy("token").agg(F.max("salts").alias("salts"), *(f(o).alias(f"{f.__name__}{i}") for i, o in enumerate(order) for f in (F.min, F.max)))
        some = F.array(*(F.struct(F.col(f"{f}{i}.rep").alias("rep"), F.col(f"{f}{i}.s").alias("s"), F.col(f"{f}{i}.component").alias("component")) for i in range(SEEDS) for f in ("min", "max")))
        pivots = pivots.select("token", "salts", F.explode(F.array_distinct(some)).alias("p"))
        pivots = pivots.select("token", "salts", F.col("p.rep").alias("query"), F.col("p.s").alias("t"), F.col("p.component").alias("mine"))
        stars = _met(lists, pivots).where(f"component <> mine and {_fits('s', 't', num, den)}").select("query", F.col("rep").alias("other")).distinct()
        stars = _untried(stars, tried)
        links = _links(stars, classes, num, den)
        tried, near = _both(stars, tried), links if near is None else near.unionByName(links)
        count = links.count()
        first = first or count
        if count:
            lists, held = _apart(lists, table(components(near), f"components-{turn}"))
        open_pairs = held.agg(F.sum(F.col("total") * (F.col("total") - F.col("most")))).first()[0] or 0
        if open_pairs <= 20 * classes_n or count <= 0.02 * first:
            break

    # then every fitting pair of a list that lies in two components
    minor = lists.join(held.select("token", "major"), "token").where("component <> major").select("token", "salts", F.col("rep").alias("query"), F.col("s").alias("t"), F.col("component").alias("mine"), "major")
    apart = f"component <> mine and (component = major or rep > query) and {_fits('s', 't', num, den)}"
    cross = _met(lists, minor).where(apart).select("query", F.col("rep").alias("other")).distinct()
    return near.unionByName(_links(_untried(cross, tried), classes, num, den))


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the least doc_id reachable by links, the row's own
    where it has none; null where only rows without an id are reachable.
    Repeated rows repeat; rows of one id with different texts are searched each.
    """
    rows = linked_rows(docs, k, num, den)
    return rows.select("doc_id", "n_shingles", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))
