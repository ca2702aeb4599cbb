"""Byte-level BPE encoding by a segment tree over adjacent pair ranks, and decoding.

Every leaf of the tree holds the merge rank of one symbol and its right
neighbour; the root is the least (rank, position), so it names the leftmost
pair of lowest rank.  A merge changes at most three leaves, each updated in
logarithmic time (nodes have FAN children, so most words need no inner node).  A pretoken of n bytes takes O(n log n), however long it is.

Nulls and empty texts have no ids.  Special tokens of the tokenizer file are
matched first, leftmost longest, as the library does by default.
"""

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, worker_state

# Fixed value: how byte-level BPE splits a text before any merge.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NO_PAIR = 1 << 62
#: Children of a node.
FAN = 16
#: Pretokens that a worker remembers at most; longer ones than MEMO_CHARS are not kept.
MEMO, MEMO_CHARS = 600_000, 64


def byte_symbols() -> dict:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


class SegmentTreeBPE(dict):
    """Encoder and decoder of a byte-level BPE tokenizer file; as a dict, the ids of pretokens met lately."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.byte_ids = [vocab[symbols[b]] for b in range(256)]
        #: left id * 2**32 + right id -> rank * 2**32, and -> merged id
        self.ranks, self.merged = {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[left] << 32 | vocab[right]
            self.ranks[key], self.merged[key] = rank << 32, vocab[left + right]
        self.token_bytes = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes.update({i: t.encode() for t, i in self.special.items()})
        size = max(self.token_bytes) + 1
        self.by_id = [self.token_bytes.get(i, b"") for i in range(size)]
        self.split = regex.compile(PRETOKENS)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def merge(self, piece: bytes) -> list:
        """Ids of one pretoken: merge the root's pair until none is left."""
        ids = list(map(self.byte_ids.__getitem__, piece))
        n = len(ids)
        if n < 2:
            return ids
        rank, merged = self.ranks.get, self.merged
        leaves = [rank(ids[i] << 32 | ids[i + 1], NO_PAIR) | i for i in range(n - 1)]
        leaves.append(NO_PAIR)
        levels = [leaves]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
        top = levels[-1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := min(top)) < NO_PAIR:
            i = root & 0xFFFFFFFF
            j = after[i]
            k = after[i] = after[j]
            h = before[i]
            new = ids[i] = merged[ids[i] << 32 | ids[j]]
            ids[j] = -1
            leaves[j] = NO_PAIR
            if k < n:
                before[k] = i
                leaves[i] = rank(new << 32 | ids[k], NO_PAIR) | i
            else:
                leaves[i] = NO_PAIR
            if h >= 0:
                leaves[h] = rank(ids[h] << 32 | new, NO_PAIR) | h
            if top is not leaves:
                for leaf in (j, i, h) if h >= 0 else (j, i):
                    for low, high in zip(levels, levels[1:]):  # noqa: B905
                        leaf //= FAN
                        least = min(low[leaf * FAN : leaf * FAN + FAN])
                        if high[leaf] == least:
                            break
                        high[leaf] = least
        return [x for x in ids if x >= 0]

    def __missing__(self, word: str) -> bytes:
        out = array("I", self.merge(word.encode())).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.__getitem__, self.split.findall(part)))
        return b"".join(out)

    def encode(self, text: str) -> list:
        """Ids of a text, without any added token."""
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; invalid UTF-8 becomes U+FFFD."""
        return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` for every row; rows repeat as they come.

    Null text is the empty text.  Other columns are not read.  A row is
    encoded whole, where it stands: no shuffle.
    """

    def run(batches):
        bpe = worker_state(f"bpe:{tokenizer}", lambda: SegmentTreeBPE(tokenizer))
        for batch in slices(batches, 64):
            ids = [np.frombuffer(bpe.encode_bytes(t or ""), dtype="<u4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.astype("<i4") for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())],
                names=["id", "ids", "decoded"],
            )

    return _one_pass(docs, id_column, text_column).mapInArrow(run, "id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As :func:`encode_documents`, but only digests leave the worker:
    ``(id, n_tokens, ids_sha256, decoded_sha256)``."""

    def run(batches):
        bpe = worker_state(f"bpe:{tokenizer}", lambda: SegmentTreeBPE(tokenizer))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, 64):
            packed = [bpe.encode_bytes(t or "") for t in batch.column(1).to_pylist()]
            decoded = [bpe.decode(np.frombuffer(b, dtype="<u4").tolist()) for b in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(b) // 4 for b in packed], pa.int64()), pa.array(map(sha, packed), pa.string()), pa.array([sha(d.encode()) for d in decoded], pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _one_pass(docs, id_column, text_column).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _one_pass(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("text"))
