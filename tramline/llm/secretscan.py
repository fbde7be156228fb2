"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The tokens of a text are its words and single signs, each with the white space before it. The field tags every one as
begin, inside or outside a secret from its shape, the shapes and words around it and features of the whole text, and
Viterbi decodes them. A token whose margin for outside is larger than all that its neighbours could gain is outside in
the best sequence; only the runs between such tokens are decoded step by step, which gives the same tags.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import batches_of, stored

# The patterns and least lengths of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
KINDS = ("assign", "access", "hex", "field")

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Every character is in one token.
TOKEN = re.compile(r"\s?(?:[^\W_]+|[^\w\s]|_)|\s")
OUTSIDE, BEGIN, INSIDE = range(3)
UNKNOWN = -1
#: Places around a token whose tokens count, and the tokens of the chains that the field learns from.
AROUND = (-3, -2, -1, 1, 2)
CHAIN = 24
#: Sampled texts, and chains of these at most, that the field learns from; both bound the driver.
MOST_TEXTS = 3_000
MOST_CHAINS = 2_500
STEPS = 100
#: Classes of the tokens that may be a secret though no base pattern finds them, as they are long and mix letters and
#: digits: they teach nothing.
KEYLIKE = (14, 18)
#: Words that a worker keeps, and characters that are tagged at once.
MOST_WORDS = 400_000
CHARS_AT_ONCE = 1_000_000
NEVER = -1e6
#: Alphabets that secrets are rewritten in, with the signs that stand between groups of them.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (("0123456789ABCDEF", ""), (_UPPER + _LOWER + "0123456789", ""), (_UPPER + _LOWER, ""), (_UPPER + "0123456789", ""), (_UPPER + _LOWER + "0123456789", "-"), ("0123456789abcdef", "_"))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, leftmost and not overlapping inside a kind, by start and kind."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _hot(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The secret values of base spans, merged where they overlap: of an assignment only what is assigned."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((ASSIGN.match(text, a).start(2), b) if kind == "assign" else (a, b) for a, b, kind in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _bucket(n: int) -> int:
    return min(n.bit_length(), 12)


def word_class(token: str) -> int:
    """A number below CLASSES for what a token looks like."""
    word = token.strip()
    if not word:
        return 0
    if not word.isalnum():
        return 1 + min("=:\"'-_./+".find(word), 8) if word in "=:\"'-_./+" else 10
    letters, digits = any(map(str.isalpha, word)), any(map(str.isdigit, word))
    size = (len(word) > 4) + (len(word) > 8) + (len(word) > 15)
    if letters and digits:
        return 11 + size + 4 * (set(word) <= set("0123456789abcdef"))
    if digits:
        return 19 + size
    if any(n in word.lower() for n in NAMES):
        return 23
    mixed = not (word.islower() or word.isupper() or word[1:].islower())
    return 24 + (size if mixed else 4 + (size > 1))


def _hash(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


@lru_cache(200_000)
def shape(token: str) -> tuple[int, ...]:
    """Numbers below the sizes of SHAPE: how a token's length, characters and the space before it look, and its word."""
    word, spaced = token.strip(), token[:1].isspace()
    kind = word_class(token)
    size = _bucket(len(word))
    turns = hexed = mix = share = 0
    if word.isalpha():
        mix = 2 * (not word.isupper()) + 4 * (not word.islower())
        share = 10 * len(set(word)) // len(word)
    elif word.isalnum():
        digits = sum(map(str.isdigit, word))
        mix = (digits > 0) + 2 * any(map(str.islower, word)) + 4 * any(map(str.isupper, word))
        turns = _bucket(sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:])))
        hexed = 1 + (set(word) <= HEX_CHARS)
        share = 10 * len(set(word)) // len(word)
    seen = "" if hexed else word.lower()
    # coarse kinds that secrets of different alphabets share
    coarse = 0
    if hexed and mix > 1:
        coarse = 1 + min(size, 6)
    elif hexed:
        coarse = 8 + min(size, 5)
    elif 24 <= kind < 28:
        coarse = 14 + kind - 24
    return (coarse, mix * 13 + size, kind * 2 + spaced, turns * 13 + size, hexed * 13 + size, share * 13 + size, _hash(word[:4] if size > 3 else seen, 1024), kind, _hash(seen, 512))


HEX_CHARS = frozenset("0123456789abcdef")
CLASSES = 30
#: How many values each number of a shape has; the last two are what other tokens see.
SHAPE = (18, 8 * 13, 2 * CLASSES, 13 * 13, 3 * 13, 11 * 13, 1024, CLASSES, 512)
FILES = 2 * 13
_STARTS = np.cumsum([0, *SHAPE[:7], *[CLASSES, 512] * len(AROUND), CLASSES**3, CLASSES * FILES])
#: Where the weights of each kind of feature begin, and how many there are.
OWN, NEAR, THREE, FILE, DIMENSIONS = _STARTS[:7], _STARTS[7:17].reshape(-1, 2), int(_STARTS[17]), int(_STARTS[18]), int(_STARTS[19])
#: What the edge of a text looks like from inside.
EDGE = (0, 0)


def file_number(text: str) -> int:
    """Of the whole text: its length, and whether it names secrets at all."""
    low = text.lower()
    return 2 * _bucket(len(text) >> 6) + any(n in low for n in NAMES)


def features(tokens: list[str], file: int) -> np.ndarray:
    """The feature numbers of every token of a text."""
    shapes = np.array(list(map(shape, tokens)), np.int64).reshape(-1, len(SHAPE))
    n, seen = len(shapes), np.zeros((len(shapes) + 6, 2), np.int64)
    seen[:] = EDGE
    seen[3 : n + 3] = shapes[:, 7:]
    around = [seen[3 + d : n + 3 + d] + start for d, start in zip(AROUND, NEAR)]
    kinds = seen[:, 0]
    three = THREE + (kinds[2 : n + 2] * CLASSES + kinds[3 : n + 3]) * CLASSES + kinds[4 : n + 4]
    return np.concatenate([shapes[:, :7] + OWN, *around, three[:, None], (FILE + kinds[3 : n + 3] * FILES + file)[:, None]], axis=1)


def rewritten(text: str, secrets: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text with each secret in another alphabet, and where they are then: what the base patterns cannot show."""
    out, places, at, size = [], [], 0, 0
    for a, b in secrets:
        number = zlib.crc32(text[a:b].encode())
        alphabet, joint = ALPHABETS[number % len(ALPHABETS)]
        chars = [alphabet[zlib.crc32(b"%d.%d" % (number, k)) % len(alphabet)] for k in range(b - a)]
        if joint:
            chars[8::9] = joint * len(chars[8::9])
            chars[-1] = alphabet[number % len(alphabet)]
        out += [text[at:a], "".join(chars)]
        places.append((size + a - at, size + b - at))
        at, size = b, size + b - at
    return "".join(out) + text[at:], places


def chains(text: str, secrets: list[tuple[int, int]], hidden: list[tuple[int, int]] = ()) -> list[tuple[np.ndarray, list[int]]]:
    """Chains of the text's tokens with tags after the sorted secrets; a chain ends outside, with CHAIN tokens or more.

    A chain with an unknown token, one that may be a secret or lies in a hidden span, is left out.
    """
    tokens = TOKEN.findall(text)
    tags, at, last, k, h = [], 0, None, 0, 0
    for t in tokens:
        start, end = at + len(t) - len(t.lstrip()), at + len(t)
        at = end
        while k < len(secrets) and secrets[k][1] < end:
            k += 1
        while h < len(hidden) and hidden[h][1] <= start:
            h += 1
        own = k if k < len(secrets) and secrets[k][0] <= start < end else None
        if own is not None:
            tags.append(INSIDE if own == last else BEGIN)
        else:
            tags.append(UNKNOWN if word_class(t) in KEYLIKE or (h < len(hidden) and hidden[h][0] < end) else OUTSIDE)
        last = own
    rows = features(tokens, file_number(text))
    out, first = [], 0
    for n, tag in enumerate(tags):
        if n + 1 == len(tags) or (tag == OUTSIDE and n + 1 - first >= CHAIN):
            if UNKNOWN not in tags[first : n + 1]:
                out.append((rows[first : n + 1], tags[first : n + 1]))
            first = n + 1
    return out


def labelled(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[np.ndarray, list[int]]]:
    """Chains with tags after the base spans of the given kinds, and those with these secrets rewritten."""
    base = base_spans(text)
    secrets, hidden = _hot(text, [s for s in base if s[2] in kinds]), _hot(text, [s for s in base if s[2] not in kinds])
    out = chains(text, secrets, hidden)
    if secrets and not hidden:
        other, places = rewritten(text, secrets)
        out += [(rows, tags) for rows, tags in chains(other, places) if any(tags)]
    return out


def viterbi(emissions: list[list[float]], transitions: list[list[float]]) -> list[int]:
    """The best tags of a chain that stands between two outside tokens; ties go to the lower tag."""
    value, back = [transitions[OUTSIDE][j] + emissions[0][j] for j in range(3)], []
    (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = transitions
    for e in emissions[1:]:
        o, b, i = value
        row, best = [], []
        for x, y, z, own in ((o + oo, b + bo, i + io, e[0]), (o + ob, b + bb, i + ib, e[1]), (o + oi, b + bi, i + ii, e[2])):
            if x >= y and x >= z:
                row.append(x + own)
                best.append(0)
            elif y >= z:
                row.append(y + own)
                best.append(1)
            else:
                row.append(z + own)
                best.append(2)
        value = row
        back.append(best)
    last = [value[j] + transitions[j][OUTSIDE] for j in range(3)]
    tags = [last.index(max(last))]
    for row in reversed(back):
        tags.append(row[tags[-1]])
    return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Words:
    """Numbers of the tokens that a worker has met, with what each adds to its own emission and to those around it."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights.astype(np.float64)
        # number 0 stands for the edge of a text, where all is outside
        self.numbers: dict[str, int] = {"": 0}
        self.kinds = np.array([EDGE[0]])
        self.own = np.array([[0.0, NEVER, NEVER]])
        self.near = self.weights[np.array([EDGE]) + NEAR[:, None]].sum(axis=2).transpose(1, 0, 2)
        self.three = self.weights[THREE:FILE].reshape(CLASSES, CLASSES, CLASSES, 3)
        self.files = self.weights[FILE:].reshape(CLASSES, FILES, 3)

    def __len__(self) -> int:
        return len(self.numbers)

    def _learn(self, tokens: list[str]) -> None:
        shapes = np.array(list(map(shape.__wrapped__, tokens)), np.int64)
        own = self.weights[shapes[:, :7] + OWN].sum(axis=1)
        own[np.array([t[:1].isspace() for t in tokens]), INSIDE] += NEVER  # no secret goes on over white space
        near = self.weights[shapes[:, None, 7:] + NEAR].sum(axis=2)
        self.kinds, self.own, self.near = np.r_[self.kinds, shapes[:, 7]], np.concatenate([self.own, own]), np.concatenate([self.near, near])
        self.numbers.update(zip(tokens, range(len(self.numbers), len(self.numbers) + len(tokens))))

    def emissions(self, texts: list[list[str]], files: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of the tokens of all texts, edges between them, and the place where each text begins."""
        if new := list(dict.fromkeys(t for tokens in texts for t in tokens if t not in self.numbers)):
            self._learn(new)
        get, flat, starts = self.numbers.get, [0, 0, 0], []
        for tokens in texts:
            starts.append(len(flat))
            flat += map(get, tokens)
            flat += [0, 0, 0]
        ids = np.array(flat)
        out, kind = self.own[ids], self.kinds[ids]
        for n, d in enumerate(AROUND):
            if d < 0:
                out[-d:] += self.near[ids[:d], n]
            else:
                out[:-d] += self.near[ids[d:], n]
        out[1:-1] += self.three[kind[:-2], kind[1:-1], kind[2:]]
        for start, tokens, file in zip(starts, texts, files):
            out[start : start + len(tokens)] += self.files[kind[start : start + len(tokens)], file]
        out[ids == 0] = (0.0, NEVER, NEVER)
        return out, np.array(starts, np.int64)


@dataclass
class Field:
    weights: np.ndarray
    transitions: np.ndarray

    def slack(self) -> float:
        """What the transitions around a token can gain at most by its not being outside."""
        t = self.transitions
        before = max(t[a, x] - t[a, OUTSIDE] for a in range(3) for x in (BEGIN, INSIDE))
        after = max(t[x, b] - t[OUTSIDE, BEGIN if b == INSIDE else b] for x in (BEGIN, INSIDE) for b in range(3))
        return float(before + after + max(0.0, (t[INSIDE] - t[BEGIN]).max()))

    def tags(self, emissions: np.ndarray) -> np.ndarray:
        """The best tags of tokens of which the first and last are outside."""
        out = np.zeros(len(emissions), np.int8)
        margin = emissions[:, OUTSIDE] - np.maximum(emissions[:, BEGIN], emissions[:, INSIDE])
        follows = np.r_[np.maximum(0, emissions[1:, INSIDE] - emissions[1:, BEGIN]), 0.0]
        open_ = np.flatnonzero(margin <= self.slack() + follows + 1e-6)
        if not len(open_):
            return out
        steps = self.transitions.tolist()
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            out[run] = viterbi(emissions[run].tolist(), steps)
        return out


#: An inside token only follows a begin or inside token.
ALLOWED = np.array([[0.0, 0.0, -1e4], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def likelihood(features: np.ndarray, tags: np.ndarray, lengths: np.ndarray, weights: np.ndarray, transitions: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood of padded chains and its gradients, by the forward-backward recursion."""
    n, most, _ = features.shape
    emit = weights[features].sum(axis=2)
    at = np.arange(n)
    forward, backward = np.zeros((most, n, 3)), np.zeros((most, n, 3))
    forward[0] = transitions[OUTSIDE] + emit[:, 0]
    for t in range(1, most):
        forward[t] = _log_sum(forward[t - 1][:, :, None] + transitions, 1) + emit[:, t]
    last = lengths - 1
    whole = _log_sum(forward[last, at] + transitions[:, OUTSIDE], 1)
    for t in range(most - 1, -1, -1):
        inner = _log_sum(transitions + (emit[:, t + 1] + backward[t + 1])[:, None, :], 2) if t + 1 < most else np.zeros((n, 3))
        backward[t] = np.where((last == t)[:, None], transitions[:, OUTSIDE], inner)
    live = np.arange(most)[:, None] < lengths
    share = np.exp(forward + backward - whole[None, :, None]) * live[:, :, None]
    gold = np.eye(3)[tags.T] * live[:, :, None]
    gap = (gold - share).transpose(1, 0, 2) / n
    flat = features.reshape(-1)
    grad = np.stack([np.bincount(flat, np.repeat(gap[:, :, s].reshape(-1), features.shape[2]), minlength=len(weights)) for s in range(3)], axis=1)
    turn = np.zeros((3, 3))
    turn[OUTSIDE] += (gold[0] - share[0]).sum(axis=0)
    turn[:, OUTSIDE] += (gold[last, at] - share[last, at]).sum(axis=0)
    score = transitions[OUTSIDE][tags[:, 0]] + transitions[:, OUTSIDE][tags[at, last]]
    for t in range(1, most):
        on = live[t]
        pair = np.exp(forward[t - 1][:, :, None] + transitions + (emit[:, t] + backward[t])[:, None, :] - whole[:, None, None])
        turn += np.einsum("ni,nj->ij", gold[t - 1][on], gold[t][on]) - pair[on].sum(axis=0)
        score[on] += transitions[tags[on, t - 1], tags[on, t]]
    score += (np.take_along_axis(emit, tags[:, :, None], 2)[:, :, 0] * live.T).sum(axis=1)
    return float((score - whole).mean()), grad, turn / n


def fit(data: list[tuple[list[list[int]], list[int]]], steps: int = STEPS, most: int = MOST_CHAINS, seed: int = 5) -> Field:
    """Maximum likelihood with a Gaussian prior on whole chains. Without data nothing is tagged."""
    weights, transitions = np.zeros((DIMENSIONS, 3)), ALLOWED.copy()
    if not data:
        weights[:, OUTSIDE] = 1.0
        return Field(weights, transitions)
    rng = np.random.default_rng(seed)
    data = [data[i] for i in sorted(rng.permutation(len(data))[:most])]
    lengths = np.array([len(t) for _, t in data])
    order = np.argsort(lengths, kind="stable")
    groups = []  # chains of like length are padded together
    for some in batches_of(order.tolist(), lengths[order].tolist(), 20_000):
        own = lengths[some]
        rows, tags = np.zeros((len(some), own.max(), len(data[0][0][0])), np.int64), np.zeros((len(some), own.max()), np.int64)
        for n, k in enumerate(some):
            rows[n, : own[n]], tags[n, : own[n]] = data[k]
        groups.append((rows, tags, own))
    first, second = np.zeros((DIMENSIONS + 3, 3)), np.zeros((DIMENSIONS + 3, 3))
    for step in range(1, steps + 1):
        grad, turn = -1e-4 * weights, np.zeros((3, 3))
        for rows, tags, own in groups:
            _, more, turns = likelihood(rows, tags, own, weights, transitions)
            grad += more * (len(own) / len(data))
            turn += turns * (len(own) / len(data))
        whole = np.concatenate([grad, np.where(ALLOWED == 0, turn, 0)])
        first, second = 0.9 * first + 0.1 * whole, 0.99 * second + 0.01 * whole**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        weights += move[:-3]
        transitions += move[-3:]
    return Field(weights.astype(np.float32), transitions)


def _teach(kinds: tuple[str, ...]):
    columns = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.int8()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                # of the chains without a secret one in eight teaches, by its content
                found = [(f.tolist(), t, any(t)) for f, t in labelled(text or "", kinds) if any(t) or zlib.crc32(f.astype("<i4").tobytes()) % 8 == 0]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else ((), (), ()), columns)], ["features", "tags", "secret"])

    return run


def train(docs: DataFrame, *, most_texts: int = MOST_TEXTS, kinds: tuple[str, ...] = KINDS) -> Field:
    """Learns from the base spans of two hash samples of about most_texts texts: of all, and of those that may hold any.

    The labels are weak: they are what the base patterns of the given kinds find. Null texts teach nothing, repeated rows count again.
    """
    may = F.col("text").rlike("(?i)password|passwd|secret|token|api_?key|AKIA") | F.col("text").rlike("[0-9a-f]{16}")
    rows = docs.select("doc_id", "text", may.alias("may")).filter("text IS NOT NULL")
    total, rich = rows.agg(F.count("*"), F.count_if("may")).first()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("field")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = (draw < most_texts / max(1, total)) | (F.col("may") & (draw < most_texts / max(1, rich)))
    taken = stored(rows.filter(wanted).select("text").mapInArrow(_teach(kinds), "features array<array<int>>, tags array<tinyint>, secret boolean"), "field-chains")
    # chains are drawn by their content, down to the bound: half with a secret and half without
    sizes = {r[0]: r[1] for r in taken.groupBy("secret").count().collect()}
    share = F.when(F.col("secret"), MOST_CHAINS / 2 / max(1, sizes.get(True, 0))).otherwise(MOST_CHAINS / 2 / max(1, sizes.get(False, 0)))
    drawn = taken.filter(F.pmod(F.xxhash64("features", "tags"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < share).toArrow()
    return fit(sorted(zip(drawn.column("features").to_pylist(), drawn.column("tags").to_pylist())))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _free(spans: list[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The sorted spans that touch none of the taken ones, which are sorted by start; one sweep over both."""
    out, k, reach = [], 0, -1
    for a, b, kind in spans:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((a, b, kind))
    return out


def field_spans(texts: list[str], own: Field, words: Words) -> list[list[tuple[int, int, str]]]:
    """The spans that the field tags in each text."""
    tokens = [TOKEN.findall(t) for t in texts]
    emissions, starts = words.emissions(tokens, [file_number(t) for t in texts])
    tags = own.tags(emissions)
    out = []
    for first, mine in zip(starts, tokens):
        spans: list[tuple[int, int, str]] = []
        found = tags[first : first + len(mine)]
        if found.any():
            ends = np.cumsum([len(t) for t in mine])
            for n in np.flatnonzero(found):
                begin = int(ends[n]) - len(mine[n].lstrip())
                if found[n] == INSIDE and spans and spans[-1][1] == begin:
                    spans[-1] = (spans[-1][0], int(ends[n]), "field")
                else:
                    spans.append((begin, int(ends[n]), "field"))
        out.append(spans)
    return out


def scan_all(texts: list[str | None], own: Field, words: Words | None = None) -> list[tuple[int, int, int, int, str, str]]:
    """Of each text the counts of each kind, the SHA-256 of the joined base spans, and all spans joined."""
    words = words or Words(own.weights)
    texts, out = [t or "" for t in texts], []
    for some in batches_of(texts, [len(t) for t in texts], CHARS_AT_ONCE):
        for text, more in zip(some, field_spans(some, own, words)):
            base = base_spans(text)
            every = sorted(base + _free(more, base), key=lambda s: (s[0], KINDS.index(s[2])))
            counts = [sum(kind == k for *_, kind in every) for k in KINDS]
            out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
    return out


def scan(text: str | None, own: Field) -> tuple[int, int, int, int, str, str]:
    return scan_all([text], own)[0]


OUT = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_field": "long", "base_sha256": "string", "spans": "string"}


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(sent.value.weights)
        for batch in batches:
            if len(words) > MOST_WORDS:
                words = Words(sent.value.weights)
            found = scan_all(batch.column("text").to_pylist(), sent.value, words)
            for n, (name, kind) in enumerate(OUT.items()):
                own = pa.int64() if kind == "long" else pa.string()
                batch = batch.set_column(batch.schema.get_field_index(name), pa.field(name, own), pa.array([x[n] for x in found], own))
            yield batch

    return run


def scanned(docs: DataFrame, own: Field) -> DataFrame:
    """docs with the columns of OUT; columns of these names are replaced.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; an assignment spans its name and
    value. A null text counts as empty, without spans. Every row stays.
    """
    names = [n for n in docs.columns if n not in OUT]
    rows = docs.select(*[F.col(f"`{n}`") for n in names], *[F.lit(None).cast(k).alias(n) for n, k in OUT.items()])
    sent = docs.sparkSession.sparkContext.broadcast(own)
    return rows.mapInArrow(_scan(sent), rows.schema)
