"""Exact nearest neighbours of a stated query set by a block matrix join.

Equal vectors are one class, so copies are compared once. Classes are dealt into blocks of candidates and blocks of
queries, and each pair of blocks is a tile. Inside a tile both sides are rounded to int8 codes with one scale a vector;
the product of the code matrices gives every inner product up to a bound that follows from the rounding errors. Pairs
whose upper bound reaches the k-th largest lower bound of their query are recomputed from the original vectors in double
precision, and a heap keeps the best of each query. Heaps over the tiles of a query give its answer.

The work is queries x candidates, as the whole answer asks; a tile holds two blocks and a strip of their product, and
gives no more than k + 1 results a query, whatever the data.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.common import stored

#: Classes in a block of candidates and in a block of queries.
BLOCK = 8192
#: Queries of a strip: a tile's products are made strip by strip.
STRIP = 256
#: Parts in which the members of a class are ranked first, so that no task sorts a hot class alone.
SALTS = 64
#: Longest stretch of components whose int8 products sum to exact float32 integers (127 * 127 * 1040 < 2^24).
EXACT = 1040

_FOUND = "key binary, own double, scores array<double>, ids array<bigint>"
_ARROW = pa.schema([("key", pa.binary()), ("own", pa.float64()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, data) of the vectors that take part; key is a digest of data, the components as they are stored."""
    import numpy as np

    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("values")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.asarray(pc.list_flatten(lists).to_numpy(zero_copy_only=False)) + 0.0  # one zero only; nulls are NaN
        row = np.repeat(np.arange(len(sizes)), sizes)
        odd = np.bincount(row[~np.isfinite(flat)], minlength=len(sizes))
        some = np.bincount(row[flat != 0], minlength=len(sizes))
        keep = np.flatnonzero((odd == 0) & (some > 0) & pc.is_valid(ids).to_numpy(zero_copy_only=False))
        ends, data, width = np.cumsum(sizes), flat.tobytes(), flat.itemsize
        rows = [data[(ends[i] - sizes[i]) * width : ends[i] * width] for i in keep]
        keys = [hashlib.blake2b(r, digest_size=16).digest() for r in rows]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["vec_id", "key", "data"])


def codes(vectors):
    """int8 codes, their scale, the length of the coded vector and of the rounding error, for each row of a float64 matrix."""
    import numpy as np

    largest = np.abs(vectors).max(axis=1)
    scale = largest / 127
    fine = scale >= np.finfo(np.float64).tiny
    scale[~fine] = 1.0  # components too small for a scale: all codes are 0 and the error is the vector
    unit = vectors / scale[:, None]
    rounded = np.clip(np.rint(unit), -127, 127)
    error = np.where(fine, np.linalg.norm(unit - rounded, axis=1) * scale, largest * np.sqrt(vectors.shape[1]))
    return rounded.astype(np.int8), scale, np.linalg.norm(rounded, axis=1) * scale, error


def products(a, b):
    """Exact inner products of int8 rows as float64, by float32 matrix products over stretches that stay integers."""
    import numpy as np

    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return out


def bounds(a, b):
    """Lower and upper bounds of the inner products of all rows of a and b, each given as codes() returns them."""
    import numpy as np

    (qa, sa, la, ea), (qb, sb, lb, eb) = a, b
    with np.errstate(over="ignore", invalid="ignore"):
        middle = products(qa, qb) * sa[:, None] * sb
        # <x, y> = <x', y'> + <x', dy> + <dx, y'> + <dx, dy>; the last terms cover the rounding of this very arithmetic
        error = la[:, None] * eb + ea[:, None] * (lb + eb) + 1e-9 * (la + ea)[:, None] * (lb + eb) + 1e-300
        low, high = middle - error, middle + error
    # products beyond the doubles have no bounds
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


def inner(a, b, left, right):
    """Inner products of the pairs (left, right) of rows, summed component by component in double precision."""
    import numpy as np

    out, step = np.empty(len(left)), max(1, (1 << 19) // a.shape[1])
    for at in range(0, len(left), step):
        x, y = a[left[at : at + step]], b[right[at : at + step]]
        total = np.zeros(len(x))
        for j in range(a.shape[1]):
            total += x[:, j] * y[:, j]
        out[at : at + step] = total
    return out


def _matrix(column: pa.ChunkedArray, double: bool):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.float64 if double else np.float32).reshape(len(column), -1).astype(np.float64)


def _best(entries, k: int) -> list[tuple[float, int]]:
    """The k first of (score, id) by falling score, then rising id."""
    return heapq.nsmallest(k, entries, key=lambda e: (-e[0], e[1]))


def _batch(rows: list[tuple[bytes, float, list[tuple[float, int]]]]) -> pa.RecordBatch:
    columns = [[r[0] for r in rows], [r[1] for r in rows], [[s for s, _ in r[2]] for r in rows], [[i for _, i in r[2]] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _tile(k: int, double: bool):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        import numpy as np

        rows = []
        if queries.num_rows and candidates.num_rows:
            a, b = _matrix(queries["data"], double), _matrix(candidates["data"], double)
            members, names = candidates["ids"].to_pylist(), queries["key"].to_pylist()
            coded_a, coded_b = codes(a), codes(b)
            own = inner(a, a, np.arange(len(a)), np.arange(len(a))).tolist()
            for at in range(0, len(a), STRIP):
                low, high = bounds(tuple(x[at : at + STRIP] for x in coded_a), coded_b)
                cut = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
                for q in range(len(low)):
                    near = np.flatnonzero(high[q] >= cut[q])
                    exact = inner(a, b, np.full(len(near), at + q), near)
                    if len(near) > k:  # all that tie with the k-th stay
                        stay = exact >= np.partition(exact, len(near) - k)[len(near) - k]
                        near, exact = near[stay], exact[stay]
                    found = _best(((s, i) for s, c in zip(exact.tolist(), near.tolist()) for i in members[c]), k)
                    rows.append((names[at + q], own[at + q], found))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merges the rows of a key, which follow each other, in one heap of k entries."""
        done: list = []
        for batch in batches:
            for key, own, scores, ids in zip(*(batch.column(n).to_pylist() for n in _ARROW.names)):
                if done and done[-1][0] == key:
                    done[-1] = (key, own, _best([*done[-1][2], *zip(scores, ids)], k))
                    continue
                if len(done) == 4096:
                    yield _batch(done)
                    done = []
                done.append((key, own, _best(zip(scores, ids), k)))
        if done:
            yield _batch(done)

    return run


def _classes(rows: DataFrame, is_query: Column, most: int) -> DataFrame:
    """(key, data, asked, ids) for each distinct vector: whether a query has it, and its smallest `most` ids."""
    salted = Window.partitionBy("key", "salt").orderBy("vec_id")
    whole = Window.partitionBy("key").orderBy("vec_id")
    ids = rows.select("key", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    # both limits are applied before their shuffles as well, so a hot class leaves each task as `most` rows
    ids = ids.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= most).drop("n")
    ids = ids.withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= most)
    ids = ids.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = rows.groupBy("key").agg(F.first("data").alias("data"), F.max(is_query).alias("asked"))
    return vectors.join(ids, "key")


def nearest(vectors: DataFrame, k: int = 20, *, is_query: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors (vec_id, values) of largest inner product with each query.

    Queries are the rows for which is_query, an expression over vec_id, holds (every row by default); each is compared
    with all rows but itself, nearest first, ties to the smaller vec_id. With fewer candidates than k all
    are given. Null and zero vectors, vectors that hold null or non-finite components and rows without an id take no
    part. Vectors of different lengths are not compared. Repeated rows count once; an id with several vectors is
    searched, and found, with each of them. An empty table gives no rows. Other columns are ignored.
    """
    if k < 1 or block < 1:
        raise ValueError("k and block must be positive")
    is_query = F.lit(True) if is_query is None else is_query
    double = dict(vectors.select("values").dtypes)["values"] == "array<double>"
    if not double:
        vectors = vectors.withColumn("values", F.col("values").cast("array<float>"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "values").mapInArrow(_packed, "vec_id bigint, key binary, data binary")
    rows = stored(rows, "vectors")
    classes = stored(_classes(rows, is_query, k + 1), "vector-classes")

    asked = classes.filter("asked")
    n_all, n_asked = classes.count(), asked.count()
    across, down = max(1, -(-n_all // block)), max(1, -(-n_asked // block))
    size = F.octet_length("data").alias("size")
    column = F.pmod(F.xxhash64("key"), F.lit(across)).alias("c")
    line = F.pmod(F.xxhash64(F.lit("query"), "key"), F.lit(down)).alias("r")
    candidates = classes.select("data", "ids", size, column, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))).alias("r"))
    queries = asked.select("key", "data", size, line, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))).alias("c"))
    tiles = queries.groupBy("size", "r", "c").cogroup(candidates.groupBy("size", "r", "c")).applyInArrow(_tile(k + 1, double), _FOUND)
    best = tiles.repartition("key").sortWithinPartitions("key").mapInArrow(_merge(k + 1), _FOUND)

    # one row for each query class; queries join it on their class, where AQE splits a hot one
    found = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "key").distinct().join(best, "key")
    hits = F.arrays_zip("ids", "scores")
    itself = F.array_position(F.transform(hits, lambda e: (e["ids"] == F.col("query_id")) & (e["scores"] == F.col("own"))), True)
    others = F.filter(hits, lambda e, i: i + 1 != itself)
    found = found.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))


#: DuckDB SQL for the query over embeddings: every query with every row.
ORACLE_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM rows q JOIN rows c ON len(q.v) = len(c.v) AND (q.vec_id <> c.vec_id OR q.v <> c.v)
  WHERE q.vec_id % 20 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM placed WHERE n <= 20
"""
