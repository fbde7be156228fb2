"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased runs of word characters, and single characters of scripts that are written without spaces.
Windows of MIN_MATCH tokens of a document are looked up by their Karp-Rabin hash among those of the benchmark; seeds of
one item on one diagonal join into maximal matches, and the longest match that is not yet marked is marked until none of
MIN_MATCH tokens is left. An item of fewer tokens has one window, the whole of it. A document is contaminated by an item
if tiles cover the threshold share of the item's tokens, in whatever order its passages stand.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import stored

MIN_MATCH = 5
THRESHOLD = 0.6
#: Benchmark text that one pass over the documents holds in memory; a larger benchmark takes more passes.
BLOCK_CHARS = 8_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Thai to Khmer and Japanese to Chinese letters.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(rf"(?:(?![{UNSPACED}])\w)+|[{UNSPACED}]")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2**64 of all windows."""
    n = max(0, len(ids) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * BASE + ids[j : j + n]
    return out


class Index:
    """Token numbers and window hashes of a block of benchmark items, by the width of their windows."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = MIN_MATCH) -> None:
        self.numbers: dict[str, int] = {}
        self.items = []
        held: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            ids = np.array([self.numbers.setdefault(t, len(self.numbers) + 1) for t in tokens(text)], np.uint64)
            own = min(width, len(ids))
            if own:
                held.setdefault(own, []).append((rolling(ids, own), len(self.items)))
            self.items.append((item_id, ids, own))
        self.windows = {}
        for own, found in held.items():
            flat = np.concatenate([h for h, _ in found])
            order = np.argsort(flat, kind="stable")
            item, place = np.repeat([n for _, n in found], [len(h) for h, _ in found]), np.concatenate([np.arange(len(h)) for h, _ in found])
            self.windows[own] = flat[order], item[order], place[order]

    def seeds(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the document, place in the item) of every shared window of a width."""
        hashes, item, place = self.windows[width]
        found = rolling(ids, width)
        if not len(found):
            return (np.zeros(0, np.int64),) * 3
        low = np.searchsorted(hashes, found)
        at = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == found)
        many = np.searchsorted(hashes, found[at], side="right") - low[at]
        where = np.repeat(at, many)
        entry = np.repeat(low[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return item[entry], where, place[entry]

    def covered(self, text: str | None) -> list[tuple[int, float, int]]:
        """(item_id, share of its tokens under tiles, tiles) of the items that share a window with the text."""
        get = self.numbers.get
        ids = np.array([get(t, 0) for t in tokens(text)], np.uint64)
        out = []
        for width in self.windows:
            item, where, place = self.seeds(ids, width)
            order = np.argsort(item, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
                if len(mine):
                    item_id, own, _ = self.items[item[mine[0]]]
                    tiles = tile(ids, own, where[mine], place[mine], width)
                    if tiles:
                        out.append((item[mine[0]], (item_id, sum(t[2] for t in tiles) / len(own), len(tiles))))
        return [found for _, found in sorted(out, key=lambda x: x[0])]


def tile(text: np.ndarray, item: np.ndarray, where: np.ndarray, place: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the text, place in the item, length), longest first, ties by place in the text and item.

    where and place are the seeds; a seed whose tokens differ (a hash collision) is left out.
    """
    same = np.ones(len(where), bool)
    for j in range(width):
        same &= text[where + j] == item[place + j]
    where, place = where[same], place[same]
    order = np.lexsort((where, where - place))
    where, place = where[order], place[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(where) != 1) | (np.diff(place) != 1)]) if len(where) else []
    ends = np.r_[starts[1:], len(where)] if len(where) else []
    queue = [(-int(e - s + width - 1), int(where[s]), int(place[s])) for s, e in zip(starts, ends)]
    heapq.heapify(queue)
    text_used, item_used, out = set(), np.zeros(len(item), bool), []
    while queue:
        length, a, b = heapq.heappop(queue)
        free = [not item_used[b + k] and a + k not in text_used for k in range(-length)]
        if all(free):
            out.append((a, b, -length))
            item_used[b : b - length] = True
            text_used.update(range(a, a - length))
            continue
        run = 0  # what is left of an overlapped match comes back by its own length
        for k, ok in enumerate([*free, False]):
            if ok:
                run += 1
            else:
                if run >= width:
                    heapq.heappush(queue, (-run, a + k - run, b + k - run))
                run = 0
    return out


def _pass(index, text: str, found: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            out = []
            at = batch.schema.get_field_index(found)
            for value, last in zip(batch.column(text), batch.column(at)):
                best = last.as_py()
                for item_id, share, tiles in own.covered(value.as_py()):
                    if share > best["coverage"] or (share == best["coverage"] and best["item_id"] is not None and item_id is not None and item_id < best["item_id"]):
                        best |= {"item_id": item_id, "coverage": share, "tiles": tiles}
                    if share >= threshold and item_id is not None:
                        best["items"].append(item_id)
                out.append(best | {"items": sorted(set(best["items"]))})
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return run


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct items in blocks of about `most` characters, by a hash of the item."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // most))
    for k in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.select(F.col("item_id").cast("long"), "text").distinct().collect()]


def tiled(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, width: int = MIN_MATCH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with a column `tiling` struct(item_id, coverage, tiles, items); a column of that name is replaced.

    item_id, coverage and tiles are of the best covered item (ties: the smallest id; null and 0 if none shares a
    window), items lists all ids at the threshold or over. Null and empty texts and items have no tiles; an item of
    fewer than `width` tokens is found where all of it stands together. Rows of docs are all kept, also repeated ones.
    Items of null id count, but are not listed. Between blocks the rows are written, so that a task holds one block.
    """
    names = [n for n in docs.columns if n != "tiling"]
    start = F.struct(F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("coverage"), F.lit(0).alias("tiles"), F.array().cast("array<long>").alias("items"))
    rows = docs.select(*[F.col(f"`{n}`") for n in names], start.alias("tiling"))
    for n, block in enumerate(_blocks(benchmark, block_chars)):
        rows = stored(rows, "tiling-rows") if n else rows
        index = docs.sparkSession.sparkContext.broadcast(Index(block, width))
        rows = rows.mapInArrow(_pass(index, "text", "tiling", threshold), rows.schema)
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows and columns of docs without those that an item covers to the threshold."""
    wrapped = docs.select("text", F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("whole"))
    return tiled(wrapped, benchmark, threshold=threshold, **options).filter(F.col("tiling.coverage") < threshold).select("whole.*")
