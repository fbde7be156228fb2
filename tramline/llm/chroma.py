"""Chroma fingerprints of audio columns, and alignment of recordings by them.

PCM samples become frames of twelve pitch classes. Sixteen rectangle filters, summed through an integral image, look at
WINDOW frames each and give two bits apiece: one packed 32-bit integer for each frame. A histogram of
the offsets between two recordings counts the bits that agree at each, and the share of differing bits over the whole
overlap decides how and whether they align.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import stored

RATE = 11_025
FRAME, HOP = 4096, 1365
LOWEST, HIGHEST = 28.0, 3520.0
WINDOW = 16
#: A filter value beyond it, either way, is an outer quarter of the two-bit scale; by the height of the filter, so that
#: on unrelated tones about half of the values are outer.
OUTER = {2: 0.45, 4: 0.30, 6: 0.22, 8: 0.18}
#: An alignment needs so many overlapping frames and at most this share of differing bits, which must also lie SIGMAS
#: deviations under what unrelated recordings have by chance: CHANCE on average, the deviation being that of one frame,
#: CHANCE_OFF, over the root of how many frames tell something new (one in six, as neighbours share most of their window).
LEAST_OVERLAP = 16
MOST_ERRORS = 0.25
CHANCE, CHANCE_OFF, SIGMAS = 0.456, 0.104, 5.0
#: Codes of query recordings that are searched together, counts of a histogram tile, recordings of one of its sides, its
#: pairs that are transformed back together, and numbers of the spectra that a worker keeps; all bound memory.
BLOCK_CODES = 200_000
TILE = 2_000_000
TILE_SIDE = 64
CHUNK = 1024
#: The share of the frequencies of codes by which pairs are first compared; it decides the time only.
LOW = 0.7
MOST_SPECTRA = 40_000_000
#: Up to so long a signal is transformed back by a matrix product, which is faster then.
MOST_POINTS = 256


def bound(overlap: np.ndarray, most_errors: float = MOST_ERRORS) -> np.ndarray:
    """The largest share of differing bits of an alignment over so many frames: 0.18 for 16, most_errors from about 32 on."""
    return np.minimum(most_errors, CHANCE - SIGMAS * CHANCE_OFF / np.sqrt(1 + np.asarray(overlap) / 6))


def filters() -> list[tuple[int, int, int]]:
    """(kind, first pitch class, height) of the sixteen filters.

    Kinds: 0 compares the halves of the classes, 1 the halves of the frames, 2 the diagonals of the quarters, 3 the
    middle third of the frames with the outer ones.
    """
    return [(n % 4, (5 * n) % (13 - height), height) for n in range(16) for height in (2 + 2 * (n // 4),)]


@lru_cache(1)
def _window() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


@lru_cache(4)
def _classes(rate: int) -> np.ndarray:
    """Maps the bins of a frame's spectrum to pitch classes; the last column takes the bins out of range."""
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = (hertz >= LOWEST) & (hertz <= HIGHEST)
    pitch = np.zeros(len(hertz), np.int64)
    pitch[used] = np.round(12 * np.log2(hertz[used] / 440.0)).astype(np.int64) % 12
    out = np.zeros((len(hertz), 12), np.float32)
    out[np.flatnonzero(used), pitch[used]] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """A row of twelve energies of sum one for each whole frame; silent frames are all zero."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    samples = np.asarray(samples, np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), 12))
    for at in range(0, len(frames), 256):  # bounds memory for long recordings
        some = frames[at : at + 256]
        power = np.empty((len(some), FRAME // 2 + 1), np.float32)
        for n in range(0, len(some), 16):  # spectra that stay in a core's cache
            spectrum = np.fft.rfft(some[n : n + 16] * _window(), axis=1)
            np.add(spectrum.real**2, spectrum.imag**2, out=power[n : n + 16])
        out[at : at + 256] = power @ _classes(rate)
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 1e-9)


@lru_cache(1)
def _sides() -> tuple[np.ndarray, ...]:
    """Of each filter: the first and past frames and classes of the two rectangles of its one side, its classes, that side's share and its outer value."""
    half, third = WINDOW // 2, WINDOW // 3
    one, two = [], []
    for kind, low, height in filters():
        high, middle = low + height, low + height // 2
        one.append(((0, WINDOW, low, middle), (0, half, low, high), (0, half, low, middle), (third, WINDOW - third, low, high))[kind])
        two.append((half, WINDOW, middle, high) if kind == 2 else (0, 0, 0, 0))
    kinds, lows, heights = np.array(filters()).T
    share = np.where(kinds == 3, (WINDOW - 2 * third) / WINDOW, 0.5)
    return np.array(one).T, np.array(two).T, lows, lows + heights, share, np.array([OUTER[h] for h in heights])


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """Unsigned packed integers, one for each run of WINDOW frames."""
    n = len(frames) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)[:, None]

    def area(first: np.ndarray | int, past: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums of frames first..past and classes low..high of every window, for every filter."""
        return image[at + past, high] - image[at + first, high] - image[at + past, low] + image[at + first, low]

    one, two, low, high, share, outer = _sides()
    whole = area(0, WINDOW, low, high)
    a = area(*one) + area(*two)
    # energy a cell of the one side against the other's, from -1 to 1; 0 where both are silent
    a, b = a / share, (whole - a) / (1 - share)
    value = np.divide(a - b, a + b, out=np.zeros(a.shape), where=a + b > 1e-6)
    # neighbouring quarters differ in one bit
    level = (value > -outer).astype(np.uint32) + (value > 0) + (value > outer)
    return (np.array([0, 1, 3, 2], np.uint32)[level] << np.arange(30, -2, -2, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _prints(rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for audio in batch.column("audio"):
                data = audio.as_py() or b""
                samples = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768
                rows.append(fingerprint(chroma(samples, rate)).view(np.int32).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.int32()))], ["id", "codes"])

    return run


def fingerprints(recordings: DataFrame, rate: int = RATE) -> DataFrame:
    """(id, codes) of recordings(id, audio): mono 16-bit little-endian PCM; too short or null audio has no codes."""
    return recordings.select(F.col("id").cast("long").alias("id"), "audio").mapInArrow(_prints(rate), "id long, codes array<int>")


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group and the place in it of every member of groups of these sizes."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Prints:
    """Recordings of at most `longest` codes, and the low frequencies of their spectra: a signal of signs for each bit."""

    def __init__(self, ids: np.ndarray, codes: list[np.ndarray], longest: int) -> None:
        self.ids, self.longest = ids, longest
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = np.concatenate([np.zeros(0, np.uint32), *codes])

    def most(self) -> int:
        return int(self.sizes.max(initial=0))

    def spectra(self, some: slice, points: int) -> np.ndarray:
        """(frequency, recording, signal), real parts of all signals before their imaginary ones.

        A last signal has at frequency 0 what the dropped frequencies can add to a product at most, a share of each side.
        """
        own, place = _spread(self.sizes[some])
        flat = self.codes[self.starts[some][:1].sum() : self.starts[some][:1].sum() + len(own)]
        signs = np.zeros((len(self.sizes[some]), points, 32), np.float32)
        signs[own, place] = 1 - 2 * (flat[:, None] >> np.arange(32, dtype=np.uint32) & 1).astype(np.float32)
        made = np.fft.rfft(signs, axis=1).transpose(1, 0, 2)
        low, high = made[: _low(points)], made[_low(points) :]
        rest = np.zeros((*low.shape[:2], 1), np.float32)
        energy = (_shares(points)[_low(points) :, None] * (high.real**2 + high.imag**2).sum(axis=2)).sum(axis=0)
        rest[0, :, 0] = np.sqrt(energy * points)
        return np.concatenate([low.real, rest, low.imag, np.zeros_like(rest)], axis=2)


def _points(least: int) -> int:
    """The least even length of signals that the transform takes fast."""
    return next(n for n in count(least + least % 2, 2) if 60**32 % n == 0)


def _low(points: int) -> int:
    """How many frequencies are kept."""
    return max(1, round((points // 2 + 1) * LOW))


def _shares(points: int) -> np.ndarray:
    """What each frequency counts in a signal."""
    return np.r_[1.0, np.full(points // 2 - 1, 2.0), 1.0] / points


@lru_cache(64)
def _back(points: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Map the real and the imaginary parts of a spectrum to the even and the odd part of its values at offsets 0..n."""
    turn = 2 * np.pi / points * np.outer(np.arange(n), np.arange(_low(points)))
    share = _shares(points)[: _low(points)]
    return (np.cos(turn) * share).astype(np.float32), (np.sin(turn) * share).astype(np.float32)


def _set(flags: np.ndarray) -> np.ndarray:
    """The places of the set ones of many flags, a multiple of eight of which few are set."""
    eights = np.flatnonzero(flags.view(np.uint64))
    return (8 * eights[:, None] + np.arange(8))[flags.reshape(-1, 8)[eights]]


def _aligned(asked: Prints, rows: Prints, x: np.ndarray, y: np.ndarray, offset: np.ndarray, most_errors: float, least_overlap: int) -> list[np.ndarray]:
    """(x, y, offset, overlap, bit errors) of those of the pairs, at each offset and its negative, that lie within the bounds."""
    x, y, offset = np.r_[x, x[offset > 0]], np.r_[y, y[offset > 0]], np.r_[offset, -offset[offset > 0]]
    valid = (offset <= asked.sizes[x] - least_overlap) & (-offset <= rows.sizes[y] - least_overlap) & (asked.ids[x] != rows.ids[y])
    x, y, offset = x[valid], y[valid], offset[valid]
    p, o = np.maximum(offset, 0), np.maximum(-offset, 0)
    overlap = np.minimum(asked.sizes[x] - p, rows.sizes[y] - o)
    pair, nth = _spread(overlap)
    bits = np.bitwise_count(asked.codes[(asked.starts[x] + p)[pair] + nth] ^ rows.codes[(rows.starts[y] + o)[pair] + nth])
    errors = np.bincount(pair, bits, minlength=len(x)) / (32 * np.maximum(overlap, 1))
    good = errors <= bound(overlap, most_errors)
    return [v[good] for v in (x, y, offset, overlap, errors)]


def matches(asked: Prints, rows: Prints, most_errors: float, least_overlap: int, kept: dict | None = None) -> tuple[np.ndarray, ...]:
    """(query, row, offset, overlap, bit errors) of all pairs of other ids within the bounds.

    The histogram of a pair counts, for every offset at once, by how many the bits that agree outnumber those that differ:
    it is the product of the spectra. The product of the low frequencies, and by the Cauchy-Schwarz inequality the
    most that the others can add, is never below it; where that reaches what an alignment needs, the codes themselves are
    compared. Signals are so long that no offset of enough overlap meets one that lies a whole length away. Products, and
    histograms of short signals, are real matrix products over tiles that stay in a core's cache.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if min(asked.most(), rows.most()) < least_overlap:
        return none
    # offsets either way at which the longest recordings may overlap enough
    n = max(asked.most(), rows.most()) - least_overlap + 1
    points = _points(max(asked.longest, rows.longest, asked.longest + rows.longest - least_overlap))
    side = max(1, min(TILE_SIDE, math.isqrt(TILE // points)))
    kept, low = {} if kept is None else kept, _low(points)
    spaces = [np.empty(low * side * side, np.float32) for _ in range(2)]
    flags, (above, other) = np.empty(n * side * side + 8, bool), np.empty((2, n if points <= MOST_POINTS else 0, CHUNK), np.float32)
    # the overlap at each offset either way is this at least; what is off covers the rounding of single precision
    overlaps, off = np.maximum(min(asked.sizes.min(), rows.sizes.min()) - np.arange(n), least_overlap), 0.5 + 0.0005 * points
    needed = (32 * overlaps * (1 - 2 * bound(overlaps, most_errors)) - off).astype(np.float32)[:, None]
    found, waiting, most = [], [], max(1, TILE // min(asked.most(), rows.most()))

    def compare() -> None:
        hits = [np.concatenate(v) for v in zip(*waiting)] if waiting else none
        for start in range(0, len(hits[0]), most):
            found.append(_aligned(asked, rows, *[v[start : start + most] for v in hits[:3]], most_errors, least_overlap))
        waiting.clear()

    for r in range(0, len(rows.ids), side):
        theirs = np.ascontiguousarray(rows.spectra(slice(r, r + side), points).transpose(0, 2, 1))
        turned = np.concatenate([-theirs[:, 33:], theirs[:, :33]], axis=1)
        for q in range(0, len(asked.ids), side):
            if (points, q) not in kept:
                if sum(k.size for k in kept.values()) > MOST_SPECTRA:
                    kept.clear()
                kept[points, q] = asked.spectra(slice(q, q + side), points)
            # the products with the conjugates of theirs
            width = kept[points, q].shape[1] * theirs.shape[2]
            real, imaginary = (space[: low * width].reshape(low, width) for space in spaces)
            np.matmul(kept[points, q], theirs, out=real.reshape(low, -1, theirs.shape[2]))
            np.matmul(kept[points, q], turned, out=imaginary.reshape(low, -1, theirs.shape[2]))
            # the larger one of each offset and its negative is looked at
            flags[n * width : n * width + 8] = False
            high = flags[: n * width].reshape(n, width)
            if points <= MOST_POINTS:
                cosines, sines = _back(points, n)
                for at in range(0, width, CHUNK):
                    to = min(at + CHUNK, width)
                    odd, even = above[:, : to - at], other[:, : to - at]
                    np.abs(np.matmul(sines, imaginary[:, at:to], out=odd), out=odd)
                    odd += np.matmul(cosines, real[:, at:to], out=even)
                    np.greater(odd, needed, out=high[:, at:to])
            else:
                whole = np.fft.irfft(real + 1j * imaginary, points, axis=0)
                np.greater(np.maximum(whole[:n], whole[-np.arange(n)]), needed, out=high)
            at, pair = np.divmod(_set(flags[: -(-n * width // 8) * 8]), width)
            x, y = np.divmod(pair, theirs.shape[2])
            waiting.append((x + q, y + r, at))
            if sum(len(v[0]) for v in waiting) >= most:
                compare()
        compare()
    x, y, offset, overlap, errors = (np.concatenate(v) for v in zip(*found)) if found else none
    order = np.lexsort((offset, np.abs(offset), errors, x, y))
    x, y, offset, overlap, errors = (v[order] for v in (x, y, offset, overlap, errors))
    best = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])] if len(x) else np.zeros(0, bool)
    return asked.ids[x][best], rows.ids[y][best], offset[best], overlap[best], errors[best]


def _by_length(ids: np.ndarray, codes: list[np.ndarray]) -> list[Prints]:
    """Recordings in classes of lengths, each up to a quarter of a power of two longer than the one before."""
    steps = [1 << max(3, (len(c) - 1).bit_length() - 3) for c in codes]
    longest = np.array([-(-max(1, len(c)) // step) * step for c, step in zip(codes, steps)], np.int64)
    return [Prints(ids[own], [codes[n] for n in own], int(n)) for n in np.unique(longest) for own in (np.flatnonzero(longest == n),)]


def _unsigned(column: pa.ListArray) -> list[np.ndarray]:
    return [np.array(c.values.to_numpy(), np.int32).view(np.uint32) for c in column]


_BLOCKS: dict[str, list[tuple[Prints, dict]]] = {}


def _match(sent, tag: str, most_errors: float, least_overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _BLOCKS:  # a worker keeps the spectra of one block
            _BLOCKS.clear()
            _BLOCKS[tag] = [(p, {}) for p in _by_length(*sent.value)]
        for batch in batches:
            for rows in _by_length(batch.column("class_id").to_numpy(), _unsigned(batch.column("codes"))):
                for asked, kept in _BLOCKS[tag]:
                    a, b, offset, overlap, errors = matches(asked, rows, most_errors, least_overlap, kept)
                    columns = [pa.array(a), pa.array(b), pa.array(offset.astype(np.int32)), pa.array(overlap.astype(np.int32)), pa.array(errors)]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "offset", "overlap", "bit_errors"])

    return run


def align(prints: DataFrame, every: int = 20, most_errors: float = MOST_ERRORS, least_overlap: int = LEAST_OVERLAP, block_codes: int = BLOCK_CODES) -> DataFrame:
    """Classes of equal fingerprints, and the classes that those of query recordings align with.

    Queries are the recordings whose id is divisible by `every`; they are searched in blocks of about block_codes codes,
    each against the codes of all classes at all offsets. The classes stay where they are: nothing is shuffled by code,
    so a common code makes no large task. Rows of kind `member` give each recording (id) its class_id, the smallest id
    with its codes. Rows of kind `match` have a query's class as id and class_id, and a class `match_id` of other codes
    with `offset` (place in the query less that in the other), `overlap` in frames and `bit_errors`, the share of
    differing bits, which lies within bound(overlap). Of a pair's offsets that pass, the one of least errors counts;
    ties: the least shift, then the smaller offset.
    A null id is a member only (its class_id may be null); recordings without codes match nothing; repeated rows stay
    repeated members; an empty table has no rows.
    """
    prints = stored(prints, "chroma-prints")
    classes = prints.groupBy("codes").agg(F.min("id").alias("class_id"), F.max((F.col("id") % every == 0).cast("int")).alias("asks"))
    classes = stored(classes.select("class_id", "codes", (F.coalesce("asks", F.lit(0)) == 1).alias("asks")), "chroma-classes")
    members = prints.join(classes.withColumnRenamed("codes", "own"), F.col("codes") == F.col("own")).select(F.lit("member").alias("kind"), "id", "class_id")

    spark = prints.sparkSession
    long_enough = classes.filter(F.col("class_id").isNotNull() & (F.size("codes") >= least_overlap))
    asked = long_enough.filter("asks")
    n_blocks = -(-(asked.agg(F.sum(F.size("codes"))).first()[0] or 0) // block_codes)
    matches = None
    for n in range(n_blocks):
        taken = asked.filter(F.pmod(F.xxhash64("class_id"), F.lit(n_blocks)) == n).select("class_id", "codes").orderBy("class_id").toArrow().combine_chunks()
        if not taken.num_rows:
            continue
        sent = spark.sparkContext.broadcast((taken.column("class_id").to_numpy(), _unsigned(taken.column("codes"))))
        found = long_enough.select("class_id", "codes").mapInArrow(_match(sent, uuid.uuid4().hex, most_errors, least_overlap), "a long, b long, offset int, overlap int, bit_errors double")
        # each block is searched by itself, so that no task holds two
        found = stored(found, "chroma-matches")
        matches = found if matches is None else matches.unionByName(found)
    if matches is None:
        matches = spark.createDataFrame([], "a long, b long, offset int, overlap int, bit_errors double")
    matches = matches.select(F.lit("match").alias("kind"), F.col("a").alias("id"), F.col("a").alias("class_id"), F.col("b").alias("match_id"), "offset", "overlap", "bit_errors")
    return members.unionByName(matches, allowMissingColumns=True)
