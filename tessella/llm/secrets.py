"""Secret scan by a linear-chain conditional random field over words.

A word is a run of value characters with the signs around it (or a run of
signs alone), so that every value of an unspaced row, query string or minified
file has a tag of its own.

Words are tagged begin, inside or outside of a secret.  A word's score comes
from its own shape, the shapes of the two words before and the one after, and
features of the whole file; tags follow by Viterbi.  A secret's span runs over
the value characters of its words.

The field is trained here, on windows of a bounded sample of documents whose
labels are the fixed base patterns, with synthetic secrets and ordinary values
that look like some (ids, paths, dates, versions, names, short hashes, numbers
with units) set into windows of plain text, so that it learns forms that the
patterns miss and leaves others alone.

Decoding is exact but skips what is certain: where "outside" leads by more
than two transitions can ever change, every best path is outside, so only the
stretches between such words are decoded.  (An "inside" after an "outside"
begins a secret as well; no transition is forbidden.  Of equal paths the one of
the first tags is taken.)

Null text is empty and has no spans.  Rows stand alone: repeats repeat.
"""

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, slices, table, worker_state

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

LONG_HEX = re.compile(r"[0-9a-f]{24,}")
VALUE = re.compile(rb"[A-Za-z0-9+/_.-]+={0,2}")
_SIGN, _CLOSES = r"[^\sA-Za-z0-9+/_.-]", r"""[^\sA-Za-z0-9+/_.\-"'({\[<]"""
#: A word: signs, a value, a closing quote and further signs up to those that open the next word; or signs alone.
_WORD = rf"""{_SIGN}*+[A-Za-z0-9+/_.-]++={{0,2}}(?:["'](?![A-Za-z0-9+/_]))?{_CLOSES}*+|{_SIGN}++"""
WORD, WORD_OF_TEXT = re.compile(_WORD.encode()), re.compile(_WORD, re.ASCII)
_SORTS = bytes(range(48, 58)), bytes(range(65, 91)), bytes(range(97, 123))
_HEX_DIGITS = b"0123456789abcdef"
KEYWORD = re.compile(rb"(?i)password|passwd|passphrase|secret|token|api_?key|credential|private|auth|bearer")
#: Words that name a value which is no secret, and forms of such values.
NAMING = re.compile(rb"(?i)commit|sha\d|md5|digest|checksum|etag|uuid|guid|version|build|revision|release|hash|request|trace|order|serial|invoice|ticket")
UUID = re.compile(rb"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
DATED = re.compile(rb"\d{4}[-/.]?\d\d[-/.]?\d\d(?:[T_.-]?\d\d.{0,14})?")
NUMBERED = re.compile(rb"[vV]?\d+(?:\.\d+)+(?:[-+._]?[a-z0-9]+)*")
MEASURED = re.compile(rb"\d+(?:\.\d+)?[A-Za-z]{1,4}")
SUFFIX = re.compile(rb"\.[a-z]{2,5}$")
WORDY = re.compile(rb"[A-Za-z][a-z]{3,}")
#: Digits and letters that :func:`shape` looks at; in other words a letter stands for any of its case.
TELLING = re.compile(rb"(?i)[0-9]|akia|ghp_|sk[-_]l|xoxb|eyjh|www\.|" + KEYWORD.pattern[4:] + b"|" + NAMING.pattern[4:])
_SAME_LETTER = bytes.maketrans(bytes(range(65, 91)) + bytes(range(97, 123)), b"A" * 26 + b"a" * 26)
#: The fit's bounds: documents in the sample at most, of each sort; their longest; secrets of one document that give a window; words on each side of a secret.
MOST_DOCS, MOST_CHARS, MOST_HITS, AROUND = 300, 20_000, 8, 12
#: Words whose shape a worker remembers, at most, and their longest.
MEMO, MEMO_BYTES = 100_000, 40
#: Transition weights stay within this bound, so that what a transition can change stays small.
MOVE = 4.0
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
PLACES = (0, -1, -2, 1)


def base_spans(text: str) -> list:
    """``(start, end, kind number, value start, value end)`` of the base patterns, in code points."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            out += [(*m.span(), 0, *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(*m.span(), 1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(*m.span(), 2, *m.span()) for m in LONG_HEX.finditer(text)]
    return out


def shape(word: bytes) -> tuple:
    """Numbers of the features that a word has."""
    value = max(VALUE.findall(word), key=len, default=b"")  # a word as WORD cuts it has one at most
    n = len(value)
    digits, upper, lower = (n - len(value.translate(None, c)) for c in _SORTS)
    kinds = (digits > 0) + (upper > 0) + (lower > 0)
    wordy = sum(map(len, WORDY.findall(value)))  # of its characters, those that stand as in words
    on = (
        True,
        n >= 6 and digits > 0 and digits < n,
        n >= 12 and kinds >= 2 and digits > 1,
        n >= 16 and kinds >= 2 and digits > 1,
        n >= 24 and kinds >= 2,
        n >= 20 and not lower and upper > 4 and digits > 0,
        n >= 16 and digits > 0 and not value.translate(None, _HEX_DIGITS),
        n >= 16 and kinds == 3,
        n >= 8 and len(set(value)) >= 0.5 * n and digits > 1,
        n >= 6 and digits == n,
        n > 0 and not digits,
        bool(KEYWORD.search(word)),
        word.endswith((b":", b"=")) and len(word) <= 2,
        word.endswith((b":", b"=")) and len(word) > 2,
        b"=" in word or b":" in word,
        word[:1] in (b'"', b"'") or word[-1:] in (b'"', b"'"),
        b"@" in word,
        b"://" in word or word.startswith((b"www.", b"//")),
        value.startswith(b"AKIA"),
        value[:4].lower() in (b"ghp_", b"sk-l", b"sk_l", b"xoxb", b"eyjh"),
        UUID.fullmatch(value) is not None,
        value.count(b"/") > 1 or value[:1] == b"/" or value[:2] == b"./",
        DATED.fullmatch(value) is not None,
        NUMBERED.fullmatch(value) is not None,
        MEASURED.fullmatch(value) is not None,
        SUFFIX.search(value) is not None,
        n >= 8 and 2 * wordy >= n,
        bool(NAMING.search(word)),
        n >= 16 and kinds > 1 and digits > 1 and 5 * wordy <= 2 * n,
        n >= 24 and kinds == 3 and 5 * wordy <= 2 * n,
    )
    return tuple(i for i, x in enumerate(on) if x)


N_SHAPE = 30
N_FILE = 4


def file_features(words: list) -> tuple:
    """Features of a whole file: always, long, and rich in assignments or in numbers."""
    n = max(1, len(words))
    signs = words.count(b"=") + words.count(b":")
    return (1.0, float(n > 200), float(signs > 0.02 * n), float(n < 40))


class _Shapes(dict):
    """word -> number of its shape; the shapes by number.  Long words are not kept."""

    def __init__(self):
        self.numbers, self.shapes, self.plain = {}, [], {}

    def __missing__(self, word: bytes) -> int:
        if len(word) > MEMO_BYTES or TELLING.search(word):
            k = self.number(shape(word))
        else:  # the shape does not depend on which letters these are
            like = word.translate(_SAME_LETTER)
            if (k := self.plain.get(like)) is None:
                k = self.plain[like] = self.number(shape(like))
        if len(word) <= MEMO_BYTES:
            self[word] = k
        return k

    def number(self, found: tuple) -> int:
        k = self.numbers.setdefault(found, len(self.shapes))
        if k == len(self.shapes):
            self.shapes.append(found)
        return k


@dataclass
class Field:
    """Weights: shape features by place, file features, and transitions between tags."""

    shapes: np.ndarray  # place, feature, tag
    files: np.ndarray  # feature, tag
    moves: np.ndarray  # from tag, to tag
    start: np.ndarray  # tag

    def __post_init__(self):
        self.seen, self.table, self.known = _Shapes(), None, 0
        self.key = hashlib.sha256(b"".join(w.tobytes() for w in (self.shapes, self.files, self.moves, self.start))).hexdigest()
        m = self.moves
        ends = np.concatenate([m, self.start[None]])  # what may stand before: a tag or the start
        # the most that another tag than outside gains by its transitions, over all neighbours (none after the last word)
        after = np.concatenate([m, np.zeros((3, 1))], axis=1)
        self.slack = max(float((ends[:, y] - ends[:, OUTSIDE]).max() + (after[y] - after[OUTSIDE]).max()) for y in (BEGIN, INSIDE))

    def classes(self, words: list) -> np.ndarray:
        """A number for each word's shape."""
        if len(self.seen) > MEMO:
            self.seen.clear()
            self.seen.plain.clear()
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))

    def place_scores(self, k: np.ndarray) -> np.ndarray:
        """Scores (place, word, tag) of words by their shape numbers."""
        if self.known < len(self.seen.shapes):  # shapes met since
            on = np.zeros((len(self.seen.shapes), N_SHAPE))
            for i, found in enumerate(self.seen.shapes):
                on[i, list(found)] = 1
            self.table, self.known = on @ self.shapes, len(on)
        return self.table[:, k]

    def emissions(self, words: list) -> np.ndarray:
        here, before, second, after = self.place_scores(self.classes(words))
        e = here + np.array(file_features(words)) @ self.files
        e[1:] += before[:-1]
        e[2:] += second[:-2]
        e[:-1] += after[1:]
        return e

    def tags(self, words: list) -> np.ndarray:
        """The best tags, by Viterbi."""
        n = len(words)
        out = np.full(n, OUTSIDE)
        if not n:
            return out
        e = self.emissions(words)
        open_ = np.flatnonzero(e[:, OUTSIDE] - np.maximum(e[:, BEGIN], e[:, INSIDE]) <= self.slack)
        if len(open_):
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                a, b = run[0], run[-1] + 1
                out[a:b] = self._viterbi(e[a:b], a > 0, b < n)
        return out

    def _viterbi(self, e: np.ndarray, after_outside: bool, before_outside: bool) -> list:
        best = e[0] + (self.moves[OUTSIDE] if after_outside else self.start)
        back = []
        for row in e[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        tag = int((best + self.moves[:, OUTSIDE] if before_outside else best).argmax())
        path = [tag]
        for row in reversed(back):
            path.append(tag := int(row[tag]))
        return path[::-1]

    def spans(self, text: str) -> list:
        """``(start, end)`` of the secrets in a text, in code points."""
        raw = text.encode()
        words = WORD.findall(raw)
        tags = self.tags(words)
        hits = np.flatnonzero(tags != OUTSIDE)
        if not len(hits):
            return []
        out, at, k = [], 0, 0
        seen, passed = 0, 0  # bytes, and the code points in them
        wanted = set(hits.tolist())
        for k, w in enumerate(words):
            at = raw.index(w, at)
            if k in wanted and (m := VALUE.search(w)):
                passed, seen = passed + len(raw[seen : at + m.start()].decode()), at + m.start()
                lo, hi = passed, passed + len(m[0])  # a value is ASCII
                if out and tags[k] == INSIDE and out[-1][2] == k - 1:  # goes on
                    out[-1] = (out[-1][0], hi, k)
                else:
                    out.append((lo, hi, k))
            at += len(w)
        return [x[:2] for x in out]


def label_words(words: list, offsets: list, spans: list) -> list:
    """Tags of words (with their offsets) under value spans; a word that only holds a part is inside the secret as well."""
    tags = [OUTSIDE] * len(words)
    for _, _, _, lo, hi in spans:
        first = True
        for i, (at, w) in enumerate(zip(offsets, words, strict=True)):
            if at < hi and at + len(w) > lo:
                if tags[i] == OUTSIDE:
                    tags[i] = BEGIN if first else INSIDE
                first = False
    return tags


_LETTERS = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
_HEX = np.array(list("0123456789abcdef"))
_STEMS = ("data", "report", "backup", "image", "render", "worker", "session", "final", "update", "north", "config", "index", "garden", "module", "bridge", "river")


def _draw(rng, n, pool=_LETTERS) -> str:
    return "".join(rng.choice(pool, int(n)))


def _stem(rng) -> str:
    return str(rng.choice(_STEMS))


#: Forms of made-up secret values.
SECRETS = {
    "mixed": lambda r: _draw(r, r.integers(16, 44)),
    "hex": lambda r: _draw(r, r.choice([24, 32, 40, 64]), _HEX),
    "access": lambda r: "AKIA" + _draw(r, 16, _LETTERS[26:]),
    "prefixed": lambda r: str(r.choice(["ghp_", "sk-live-", "xoxb-"])) + _draw(r, 32),
    "short": lambda r: _draw(r, r.integers(8, 16)) + str(r.integers(10, 99)),
}
#: Forms of ordinary values that look like secrets.
ORDINARY = {
    "uuid": lambda r: getattr("-".join(_draw(r, n, _HEX) for n in (8, 4, 4, 4, 12)), str(r.choice(["lower", "upper"])))(),
    "url": lambda r: f"https://{_stem(r)}.example.org/{_stem(r)}/{_draw(r, 1)}{r.integers(1, 999)}/{_stem(r)}-{_stem(r).title()}_{r.integers(1, 99)}",
    "path": lambda r: f"/{_stem(r)}/{_stem(r)}_{r.integers(1, 999)}/{_stem(r)}.{r.choice(['py', 'txt', 'json', 'tar'])}",
    "stamp": lambda r: f"20{r.integers(10, 30)}{r.integers(10, 13)}{r.integers(10, 29)}T{r.integers(10, 24)}{r.integers(10, 60)}00Z",
    "date": lambda r: f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}T{r.integers(10, 24)}.{r.integers(10, 60)}",
    "version": lambda r: f"{r.choice(['v', ''])}{r.integers(0, 20)}.{r.integers(0, 50)}.{r.integers(0, 99)}{r.choice(['', '-rc1', '+build7', '.dev20240101'])}",
    "name": lambda r: str(r.choice(["-", "_"])).join(_stem(r) for _ in range(int(r.integers(2, 5)))) + f"-{r.integers(1, 9999)}",
    "camel": lambda r: _stem(r) + "".join(_stem(r).title() for _ in range(int(r.integers(1, 4)))) + str(r.integers(1, 999)),
    "unit": lambda r: f"{r.integers(1, 99999)}{r.choice(['ms', 'kg', 'px', 'MiB', 'Hz'])}",
    "short hash": lambda r: _draw(r, r.integers(7, 13), _HEX),
    "reference": lambda r: f"10.{r.integers(1000, 99999)}/{_stem(r)}.{r.integers(1, 9999)}",
}
_KEYS = ("token", "password", "secret", "api_key", "passwd", "apikey", "API_KEY", "Token", "passphrase")
_NAMES = {"uuid": ("id", "uuid", "trace"), "stamp": ("build", "at"), "date": ("since", "date"), "version": ("version", "release"), "short hash": ("commit", "revision", "hash"), "name": ("name", "build"), "camel": ("call", "field"), "reference": ("doi", "see"), "unit": ("in", "of")}


def synthetic(rng, forms=tuple(SECRETS)) -> tuple:
    """Words of a made-up secret with their tags."""
    value = SECRETS[str(rng.choice(forms))](rng)
    key, quote, form = str(rng.choice(_KEYS)), str(rng.choice(["", '"', "'"])), int(rng.integers(5))
    if form == 0:
        return [key, "=", f"{quote}{value}{quote}"], [OUTSIDE, OUTSIDE, BEGIN]
    if form == 1:
        return [f"{key}:", f"{quote}{value}{quote}"], [OUTSIDE, BEGIN]
    if form == 2:
        return [f"{key}=", f"{quote}{value}{quote}"], [OUTSIDE, BEGIN]
    if len(value) < 20:
        return [f"{key}:", value], [OUTSIDE, BEGIN]
    words = WORD_OF_TEXT.findall(f"{quote}{value}{quote}{rng.choice(['', '.', ','])}")
    return words, [BEGIN, *[OUTSIDE] * (len(words) - 1)]


def ordinary(rng, forms=tuple(ORDINARY)) -> list:
    """Words of a made-up value that is no secret, sometimes after a word that names it."""
    kind = str(rng.choice(forms))
    quote, value = str(rng.choice(["", "", '"', "'"])), ORDINARY[kind](rng)
    named = str(rng.choice(_NAMES[kind])) + str(rng.choice([" ", ": ", "=", " = "])) if kind in _NAMES and rng.random() < 0.7 else ""
    return WORD_OF_TEXT.findall(f"{named}{quote}{value}{quote}{rng.choice(['', '.', ','])}")


def fit(texts: list, seed: int = 11, steps: int = 200, secret_forms=tuple(SECRETS), ordinary_forms=tuple(ORDINARY)) -> Field:
    """Train on texts (labels: the base patterns) by gradient ascent of the conditional likelihood."""
    rng = np.random.default_rng(seed)
    width = 2 * AROUND + 2
    windows = []
    for text in texts:
        found = list(WORD_OF_TEXT.finditer(text))
        words, offsets = [m[0] for m in found], [m.start() for m in found]
        if not words:
            continue
        files = file_features([w.encode() for w in words])
        tags = label_words(words, offsets, base_spans(text))
        hits = [i for i, t in enumerate(tags) if t == BEGIN][:MOST_HITS]
        for i in hits:
            windows.append((words[max(0, i - AROUND) : i + AROUND], tags[max(0, i - AROUND) : i + AROUND], files))
        for i in rng.integers(0, len(words), 2):
            piece, mark = words[i : i + 2 * AROUND], tags[i : i + 2 * AROUND]
            windows.append((piece, mark, files))
            if OUTSIDE in mark and all(t == OUTSIDE for t in mark):
                more, on = synthetic(rng, secret_forms)
                for words_in, tags_in in ((more, on), (plain := ordinary(rng, ordinary_forms), [OUTSIDE] * len(plain))):
                    k = int(rng.integers(0, len(piece) + 1))
                    windows.append(([*piece[:k], *words_in, *piece[k:]][:width], [*mark[:k], *tags_in, *mark[k:]][:width], files))
    if not windows:
        for _ in range(50):
            more, on = synthetic(rng, secret_forms)
            plain = ordinary(rng, ordinary_forms)
            windows.append((["the", *more, "of"], [OUTSIDE, *on, OUTSIDE], (1.0, 0.0, 0.0, 1.0)))
            windows.append((["the", *plain, "of"], [OUTSIDE] * (len(plain) + 2), (1.0, 0.0, 0.0, 1.0)))
    n, length = len(windows), max(len(w) for w, _, _ in windows)
    on = np.zeros((n, length, N_SHAPE), dtype=np.float32)
    y, mask, files = np.full((n, length), OUTSIDE), np.zeros((n, length)), np.array([f for *_, f in windows])
    for s, (words, tags, _) in enumerate(windows):
        y[s, : len(tags)], mask[s, : len(tags)] = tags, 1
        for i, w in enumerate(words):
            on[s, i, list(shape(w.encode()))] = 1
    x = np.zeros((n, length, len(PLACES), N_SHAPE), dtype=np.float32)
    for p, place in enumerate(PLACES):
        lo, hi = max(0, -place), length - max(0, place)
        x[:, lo:hi, p] = on[:, lo + place : hi + place]
    flat = x.reshape(n, length, -1)
    here = mask[..., None] > 0
    gold = np.eye(3)[y] * mask[..., None]
    weights = [np.zeros((flat.shape[2], 3)), np.zeros((N_FILE, 3)), np.zeros((3, 3)), np.zeros(3)]
    seen = [np.zeros_like(w) for w in weights]
    first_moment = [np.zeros_like(w) for w in weights]
    total = mask.sum()
    for step in range(1, steps + 1):
        e = (flat @ weights[0].astype(np.float32)).astype(float) + (files @ weights[1])[:, None]
        moves, start = weights[2], weights[3]
        # forward and backward, each position scaled to sum 1; where the mask ends, states are carried on unchanged
        odds, turn = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(moves)
        alpha, beta = np.zeros((n, length, 3)), np.full((n, length, 3), 1 / 3)
        scaled = lambda a: a / a.sum(axis=1, keepdims=True)
        alpha[:, 0] = scaled(odds[:, 0] * np.exp(start))
        for t in range(1, length):
            alpha[:, t] = np.where(here[:, t], scaled(alpha[:, t - 1] @ turn * odds[:, t]), alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            beta[:, t] = np.where(here[:, t + 1], scaled((odds[:, t + 1] * beta[:, t + 1]) @ turn.T), beta[:, t + 1])
        p = alpha * beta
        p *= mask[..., None] / p.sum(axis=2, keepdims=True)
        pair = alpha[:, :-1, :, None] * turn * (odds[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair *= (mask[:, 1:] / pair.sum(axis=(2, 3)))[..., None, None]
        d = gold - p
        gradients = [
            flat.reshape(n * length, -1).T @ d.reshape(n * length, 3).astype(np.float32),
            files.T @ d.sum(axis=1),
            (gold[:, :-1, :, None] * gold[:, 1:, None, :]).sum(axis=(0, 1)) - pair.sum(axis=(0, 1)),
            d[:, 0].sum(axis=0),
        ]
        for k, g in enumerate(gradients):
            g = g / total - 1e-5 * weights[k]
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
            seen[k] = 0.99 * seen[k] + 0.01 * g * g
            weights[k] = weights[k] + 0.1 * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(seen[k] / (1 - 0.99**step)) + 1e-8)
        weights[2], weights[3] = np.clip(weights[2], -MOVE, MOVE), np.clip(weights[3], -MOVE, MOVE)
    return Field(weights[0].reshape(len(PLACES), N_SHAPE, 3), weights[1], weights[2], weights[3])


def _least_hashes(marked: DataFrame, likely: bool, most: int, rows: int) -> list:
    """The distinct texts of least hash, ``most`` at most, of those that are likely to hold a base secret, or of the others.

    The patterns are tried on a share of the hashes only, which grows until it
    holds enough; what a share holds is written, deduplicated, without the rest.
    """
    share = min(1.0, 10 * most / max(1, rows))
    while True:
        top = F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))
        part = table(marked.where(F.col("h") <= top).where(F.col("likely") == likely).select("h", "text").dropDuplicates(["h"]), "secret-sample")
        found = part.count()
        if found >= most or share >= 1:
            return [r["text"] for r in part.orderBy("h").limit(most).collect()]
        share = min(1.0, share * max(2.0, min(16.0, 1.3 * most / max(1, found))))


def train(docs: DataFrame, most: int = MOST_DOCS) -> Field:
    """A field from at most ``most`` documents of up to MOST_CHARS characters that may hold a base secret, and as many others, chosen by a hash of the text."""
    text = docs.select(docs["text"].cast("string").alias("text")).where(F.length("text").between(1, MOST_CHARS))
    low = F.lower("text")
    likely = F.col("text").contains("AKIA") | ((F.col("text").contains("=") | F.col("text").contains(":")) & F.greatest(*(low.contains(k) for k in KEYWORDS))) | F.col("text").rlike("[0-9a-f]{24}")
    marked, rows = text.select("text", F.xxhash64("text").alias("h"), likely.alias("likely")), docs.count()
    with scratch(docs.sparkSession):
        sample = {t for flag in (True, False) for t in _least_hashes(marked, flag, most, rows)}
    return fit(sorted(sample))


def own(field: Field | None) -> Field | None:
    """The worker's copy of a field, so that the words it remembers outlive a task; a worker keeps one."""
    if field is None:
        return None
    held = worker_state("secret-field", dict)
    if held.get("key") != field.key:
        held.update(key=field.key, field=field)
    return held["field"]


def scan(text: str, field: Field | None) -> list:
    """All spans ``(start, end, kind number, value start, value end)`` of a text, by start, then kind.

    The field adds what no base span holds already.
    """
    base = base_spans(text)
    extra, ends, far = [], sorted(s[:2] for s in base), 0
    k = 0  # base spans so far, all of which start at or before this one
    for a, b in [] if field is None else field.spans(text):  # by start
        while k < len(ends) and ends[k][0] <= a:
            far, k = max(far, ends[k][1]), k + 1
        if b > far:
            extra.append((a, b, 3, a, b))
    return sorted(base + extra, key=lambda s: (s[0], s[2], s[1]))


def redact(text: str, spans: list, mask: str = "[SECRET]") -> str:
    """The text with each secret value replaced; overlapping values are replaced together."""
    out, at = [], 0
    merged: list = []
    for _, _, _, lo, hi in sorted(spans, key=lambda s: s[3]):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    for lo, hi in merged:
        out += [text[at:lo], mask]
        at = hi
    return "".join([*out, text[at:]])


def listed(spans: list, kinds=range(len(KINDS))) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, *_ in spans if k in kinds)


def scan_documents(docs: DataFrame, field: Field | None, redacted: bool = False) -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_spans, spans[, redacted])`` of every row; ``redacted``: also the text without its secrets."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ("n_assign", "n_access", "n_hex", "base_spans", "spans", "redacted")
    width = 6 if redacted else 5

    def run(batches):
        mine = own(field)
        for batch in slices(batches, 128):
            rows = []
            for text in batch.column(1).to_pylist():
                found = scan(text or "", mine)
                n = Counter(k for _, _, k, *_ in found)
                row = (n[0], n[1], n[2], listed(found, (0, 1, 2)), listed(found))
                rows.append((*row, redact(text, found) if text is not None else None) if redacted else row)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[:width], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names[:width]])

    rows = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base_spans string, spans string" + ", redacted string" * redacted)


def redact_documents(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with each secret value of ``text`` replaced (and ``n_chars``, where there is one, counted anew); all other columns and all rows stay."""
    names = docs.columns

    def run(batches):
        mine = own(field)
        for batch in slices(batches, 128):
            texts = [t if t is None else redact(t, scan(t, mine)) for t in batch.column(names.index("text")).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[names.index("text")] = pa.array(texts, batch.schema.field(names.index("text")).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                counted = [old if t is None else len(t) for t, old in zip(texts, batch.column(k).to_pylist(), strict=True)]
                columns[k] = pa.array(counted, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
