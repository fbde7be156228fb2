"""Periodic runs of words, found by probing a harmonic grid.

A run of period q holds 3q places at least where the word equals the one q further on, so three multiples of q in a row
among them. For every period p the words at jp and (j + 1)p are compared, which are n / p comparisons and n ln n over all
periods; where three in a row agree, sums of hashes rule out stretches that differ in between, and what is left is
extended to both sides by comparing chunks of growing length. A grid point that lies within a run found for a divisor of p is skipped,
as it can only find that run again, and so are the grid points of a stretch that has been extended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import batches_of

#: Shortest run, in words and in periods.
LEAST, REPEATS = 6, 4
SEED = 42
#: Grid points that are compared at once.
GRID = 1 << 20
#: Bytes of text that are returned in one batch.
MOST_BYTES = 16 << 20
#: First stretch of an extension; it doubles until a word differs.
STRETCH = 32

WORDS = re.compile("[^\x20\x09-\x0d]+")


def _reach(words, at: int, p: int, step: int) -> int:
    """How many places from `at` on in direction step hold a word equal to the one p further on."""
    import numpy as np

    n, length, size = 0, STRETCH, len(words) - p
    while True:
        room = min(length, size - at - n if step > 0 else at - n + 1)
        if room <= 0:
            return n
        low = at + n if step > 0 else at - n - room + 1
        same = words[low : low + room] == words[low + p : low + p + room]
        if not same.all():
            return n + int(np.argmin(same if step > 0 else same[::-1]))
        n, length = n + room, min(2 * length, GRID)


def _inside(starts: list[int], ends: list[int], points, p: int):
    """Which points lie, with the three grid points that follow, in one of the runs of one period, given in order."""
    import numpy as np

    at = np.searchsorted(np.array(starts), points, side="right") - 1
    return (at >= 0) & (points + 3 * p < np.array(ends)[np.maximum(at, 0)])


class _Hashes:
    """Sums of word hashes times powers, modulo 2^64, made when first asked for: equal stretches have equal sums."""

    def __init__(self, words):
        self.words, self.made = words, None

    def __call__(self):
        import numpy as np

        if self.made is None:
            rng = np.random.default_rng(SEED)
            powers = np.full(len(self.words) + 1, int(rng.integers(1 << 62)) * 2 + 1, np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers)
            drawn = rng.integers(0, 1 << 63, int(self.words.max()) + 1).astype(np.uint64)
            self.made = np.concatenate([np.zeros(1, np.uint64), np.cumsum(drawn[self.words] * powers[:-1])]), powers
        return self.made


def _survivors(words, low: int, high: int, hashes: _Hashes):
    """(p, point) of the grid points of the periods low to high - 1 that begin two periods of agreement, in order.

    Sums of hashes may let others pass, which comparing words then drops; they never drop one.
    """
    import numpy as np

    n = len(words)
    if high - low == 1:
        grid = words[::low]
        same = grid[:-1] == grid[1:]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * low
        periods = np.full(len(hits), low)
    else:
        ps = np.arange(low, high)
        sizes = (n - 1) // ps  # comparisons of each period
        first = np.cumsum(sizes) - sizes
        p = np.repeat(ps, sizes)
        j = np.arange(len(p)) - np.repeat(first, sizes)
        points = j * p
        same = words[points] == words[points + p]
        three = same[:-2] & same[1:-1] & same[2:] & (p[:-2] == p[2:])
        hits, periods = points[:-2][three], p[:-2][three]
    if len(hits):  # all places up to the second next grid point must agree as well
        sums, powers = hashes()
        stay = (sums[hits + 2 * periods] - sums[hits]) * powers[periods] == sums[hits + 3 * periods] - sums[hits + periods]
        hits, periods = hits[stay], periods[stay]
    return periods, hits


def runs(words) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run in an integer array, by start and period.

    A run of smallest period q is at least LEAST words and REPEATS periods long.
    """
    import numpy as np

    n = len(words)
    by_period: dict[int, tuple[list[int], list[int]]] = {}
    found: set[tuple[int, int]] = set()
    p, last, hashes = 1, n // REPEATS, _Hashes(words)
    while p <= last:
        # periods whose grids together have about GRID points
        high = min(last + 1, p + max(1, GRID * p // n))
        periods, points = _survivors(words, p, high, hashes)
        edges = (np.flatnonzero(np.diff(periods)) + 1).tolist()
        at = 0
        for end in [*edges, len(points)] if len(points) else ():
            q, some = int(periods[at]), points[at:end]
            at = end
            for d, (starts, ends) in by_period.items():
                if len(some) and q % d == 0:
                    some = some[~_inside(starts, ends, some, q)]
            passed, mine = -1, ([], [])
            for point in some.tolist():
                if point <= passed:
                    continue
                start = point - _reach(words, point - 1, q, -1) if point else 0
                passed = point + _reach(words, point, q, 1) - 1
                stop = passed + 1 + q
                if stop - start >= max(LEAST, REPEATS * q) and (start, stop) not in found:
                    found.add((start, stop))
                    mine[0].append(start)
                    mine[1].append(stop)
            if mine[0]:
                by_period[q] = mine
        p = high
    return sorted((s, e - s, q) for q, (starts, ends) in by_period.items() for s, e in zip(starts, ends))


def kept(n: int, found: list[tuple[int, int, int]]):
    """Which of n words stay when every run is cut to its first period."""
    import numpy as np

    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def collapse(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs, and the words that stay, joined by one space; a null text has none."""
    import numpy as np

    words = WORDS.findall(text or "")
    number: dict[str, int] = {}
    found = runs(np.array([number.setdefault(w, len(number)) for w in words], np.int32)) if words else []
    stay = [w for w, k in zip(words, kept(len(words), found).tolist()) if k] if found else words
    return len(words), found, " ".join(stay)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        sizes, at = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0
        for some in batches_of(list(range(len(ids))), sizes, MOST_BYTES):
            n, found, text = zip(*(collapse(texts[i].as_py()) for i in some))
            listed = [[dict(zip(("start", "length", "period"), r)) for r in f] for f in found]
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(some)), pa.array(n, pa.int64()), pa.array(listed, _RUNS), pa.array(text, pa.string())], ["doc_id", "n_words", "runs", "text"])
            at += len(some)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, text) for every row: all periodic runs of its words and the text cut to one period of each.

    Words are separated by ASCII white space and numbered from 0; runs is an array of (start, length, period) by start
    and period. A run is maximal, has its smallest period, and is at least six words and four periods long; words after
    its first period are dropped from text, and what stays is joined by one space. Null, empty and blank texts have no
    words, no runs and an empty text; null ids and repeated rows stay as they are; an empty table gives no rows. Columns
    other than doc_id and text are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scan, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with runs planted by rule in a tenth of the documents, as a test of the scan.

    With h the CRC-32 of the id in decimal and g = h div 10, where h mod 10 is 0 the words from a = g mod n on repeat the
    p = 1 + (n - a) div (3 + g mod 8) words there. Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit("[^ \\x09-\\x0D]+"), F.lit(0))))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.array_join(F.transform(places, lambda i: F.get("words", source(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))
