"""SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of three differing bits at most one falls into one of the two,
so two linked fingerprints share a segment but for one bit: each segment is indexed under its 32 one-wildcard variants,
an equality join on the variants finds every candidate and a bit count verifies it. Copies with one fingerprint are one
row of the index, and an index key with many fingerprints is cut once more by the same rule inside the other segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import stored
from tramline.llm.components import components

SEED = 42
MOST_BITS = 3
#: Index keys with more fingerprints than this are cut again.
SPLIT_OVER = 256


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of 3-word shingles: a bit is set if over half the shingle hashes have it; 0 without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ bits for j in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column("text")]
        signed = pa.array([p - (1 << 64) if p >> 63 else p for p in prints], pa.int64())
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], signed], [*names, "fp"])


def fingerprints(docs: DataFrame, *carry: Column) -> DataFrame:
    """(doc_id, carried columns, fp): the fingerprint of each whole text as a signed long; a null text has no words."""
    rows = docs.select("doc_id", *carry, F.col("text").cast("string").alias("text"))
    out = rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema
    return rows.mapInArrow(_fingerprints, out)


def _low(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def _variants(value: Column, shifts: tuple[int, ...], width: int) -> Column:
    """All one-wildcard variants of the segments at the given shifts: segment number, wildcard and the other bits."""
    out = []
    for n, shift in enumerate(shifts):
        for bit in range(width):
            kept = _low(value, shift, width).bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)))
            out.append(kept.bitwiseOR(F.lit((n << 40) | (bit << 32))))
    return F.array(*out)


def _first_shared(key: Column, differs: tuple[Column, Column]) -> Column:
    """True for one key only of those that a pair shares, given how many bits differ in segment 0 and 1."""
    segment, bit = F.shiftright(key, 40), F.shiftright(key, 32).bitwiseAND(F.lit(255))
    first = (segment == 0) & ((differs[0] == 1) | (bit == 0))
    return first | ((segment == 1) & (differs[0] > 1) & ((differs[1] == 1) | (bit == 0)))


def links(prints: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """(u, v): each pair u < v of the distinct values of prints.fp that differ in at most three bits, once."""
    keyed = prints.select("fp", F.explode(_variants(F.col("fp"), (0, 32), 32)).alias("key"))
    # counted before the shuffle and joined back, where AQE splits a hot key
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # the size of exploded rows is guessed from those before, so these joins must not be left to a broadcast
    keyed = stored(keyed.hint("merge").join(shared, "key"), "simhash-index")  # few keys are shared, so this is much smaller than the index

    def pairs(index: DataFrame, on: list[str], extra) -> DataFrame:
        a, b = index.alias("a"), index.alias("b")
        apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
        halves = tuple(F.bit_count(_low(apart, s, 32)) for s in (0, 32))
        found = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(apart) <= MOST_BITS) & _first_shared(F.col("a.key"), halves)
        for name in on:
            found = found & (F.col(f"a.{name}") == F.col(f"b.{name}"))
        return a.hint("merge").join(b, found & extra(apart)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    cold = pairs(keyed.filter(F.col("n") <= split_over), ["key"], lambda apart: F.lit(True))
    other = F.when(F.shiftright("key", 40) == 0, _low(F.col("fp"), 32, 32)).otherwise(_low(F.col("fp"), 0, 32))
    hot = keyed.filter(F.col("n") > split_over).select("fp", "key", F.explode(_variants(other, (0, 16), 16)).alias("sub"))

    def once(apart: Column) -> Column:
        rest = F.when(F.shiftright("a.key", 40) == 0, _low(apart, 32, 32)).otherwise(_low(apart, 0, 32))
        return _first_shared(F.col("a.sub"), tuple(F.bit_count(_low(rest, s, 16)) for s in (0, 16)))

    return cold.unionByName(pairs(hot, ["key", "sub"], once))


def _components(rows: DataFrame, split_over: int) -> DataFrame:
    """(fp, component) of each distinct fingerprint; component is a fingerprint that stands for all it reaches."""
    prints = rows.select("fp").distinct()
    reached = components(links(prints, split_over))
    return prints.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable over links.

    Null and wordless texts have fingerprint zero and link like any other. Null ids are kept; they never are the
    smallest, and a component of null ids only has a null component_id. Repeated rows stay repeated; an empty table
    gives no rows. Columns other than doc_id and text are ignored.
    """
    rows = stored(fingerprints(docs), "simhash-rows")
    prints = _components(rows, split_over).join(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fp")
    ids = prints.groupBy("component").agg(F.min("least_id").alias("component_id"))
    # one row for each fingerprint; the documents join it on their fingerprint, where AQE splits a hot one
    return rows.join(prints.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """The rows of docs, one of each component: that of the smallest doc_id, of repeated ids that of the smallest hash.

    Of rows with equal id and text (null counts as empty) any one is kept. A row without an id is kept only where its component has no id.
    """
    hashed = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash")
    # a row is named by its id, or the least long for none, and the hash of its text
    name = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("name")
    rows = stored(fingerprints(docs, hashed), "simhash-rows")
    kept = rows.join(_components(rows, split_over), "fp").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), name, "hash")).alias("least"))
    kept = kept.select("least.name", "least.hash")
    # repeated rows are combined before the shuffle that the join shares
    whole = docs.select(name, hashed, F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("whole")).groupBy("name", "hash").agg(F.first("whole").alias("whole"))
    return whole.join(kept, ["name", "hash"]).select("whole.*")
