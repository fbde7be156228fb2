"""Effects of a stream that take place once for each event: a ledger of runs, and failed rows that come again.

A run is a micro-batch, or a retry after it. Before an effect the run's rows are written to todo/run=N: new events, and
those that failed in the run before and have tries left. After it the outcome of each row is written to attempts/run=N,
which ends the run. A run that was cut off has no outcome: when its batch comes again it is done anew in place, so an
effect that writes must overwrite what the same run has left. Events known to an earlier run are not new, whatever
became of them, so an event is delivered once however often the source repeats it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers of runs between two batches; a retry takes the next after the last run.
PER_BATCH = 1000
MOST_TRIES = 3

#: An effect takes rows (with `tries`, the failures before) and the run's number, and gives (key, ok, error).
Effect = Callable[[DataFrame, int], DataFrame]


class Interrupted(Exception):
    """Raised by an effect to end the query; its run is done anew when the query is started again."""


def ended_runs(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the runs whose outcome is written, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/attempts")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = [p.getPath() for p in files.listStatus(path)]
    return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("run=") and files.exists(p.suffix("/_SUCCESS")))


def _read(spark: SparkSession, folder: str, kind: str, runs: list[int], schema: T.StructType) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/{kind}").parquet(*[f"{folder}/{kind}/run={n}" for n in runs])


def _schemas(columns: T.StructType, key: str) -> tuple[T.StructType, T.StructType]:
    todo = T.StructType([f for f in columns if f.name not in ("tries", "run")]).add("tries", T.IntegerType())
    return T.StructType([*todo, T.StructField("run", T.IntegerType())]), T.StructType([columns[key]]).add("ok", T.BooleanType()).add("error", T.StringType()).add("run", T.IntegerType())


def _open(spark: SparkSession, folder: str, runs: list[int], columns: T.StructType, key: str, most_tries: int) -> DataFrame:
    """Rows that failed in the last run and may be tried again, with `tries`."""
    todo, attempts = _schemas(columns, key)
    last = runs[-1:]
    failed = _read(spark, folder, "attempts", last, attempts).filter("NOT ok").select(key)
    rows = _read(spark, folder, "todo", last, todo).join(failed, key).withColumn("tries", F.col("tries") + 1)
    return rows.filter(F.col("tries") < most_tries).select(*[f.name for f in todo if f.name != "run"])


def run(batch: DataFrame, number: int, folder: str, effect: Effect, key: str = "event_key", most_tries: int = MOST_TRIES, remember: int | None = None) -> None:
    """Does one run over a batch: effect for its new events and for those still open.

    Of repeated events of a batch the least row counts; rows without a key are left out. remember bounds how many runs
    back an event is known (all by default). An effect that raises fails all rows of its run, and a row that it gives no
    outcome for has failed; both come again in the next run until most_tries. Columns called tries or run are not kept.
    """
    spark = batch.sparkSession
    todo_schema, _ = _schemas(batch.schema, key)
    names = [f.name for f in todo_schema if f.name not in ("tries", "run")]
    before = [n for n in ended_runs(spark, folder) if n < number]
    known = _read(spark, folder, "todo", before if remember is None else before[-remember:], todo_schema).select(key).distinct()
    rest = [n for n in names if n != key]
    new = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest, F.lit(0).alias("_"))).alias("row"))
    new = new.select(*[F.col(key) if n == key else F.col(f"row.`{n}`").alias(n) for n in names], F.lit(0).alias("tries")).join(known, key, "left_anti")
    still = _open(spark, folder, before, batch.schema, key, most_tries)
    new.select(*names, "tries").unionByName(still).write.mode("overwrite").parquet(f"{folder}/todo/run={number}")
    rows = _read(spark, folder, "todo", [number], todo_schema).drop("run")
    failed = F.coalesce(F.col("ok"), F.lit(False))
    try:
        said = effect(rows, number).select(key, "ok", "error")
        out = rows.select(key).join(said.groupBy(key).agg(F.bool_and("ok").alias("ok"), F.max("error").alias("error")), key, "left").select(key, failed.alias("ok"), "error")
        out.write.mode("overwrite").parquet(f"{folder}/attempts/run={number}")
    except Interrupted:
        raise
    except Exception as problem:  # noqa: BLE001 - its rows are written down as failed and come again
        out = rows.select(key, F.lit(False).alias("ok"), F.lit(str(problem)[:500]).alias("error"))
        out.write.mode("overwrite").parquet(f"{folder}/attempts/run={number}")


def retry(spark: SparkSession, like: DataFrame, folder: str, effect: Effect, key: str = "event_key", most_tries: int = MOST_TRIES) -> int:
    """Does a run over the open rows alone, as when no batch comes; gives its number. like has the events' columns."""
    number = (ended_runs(spark, folder) or [-1])[-1] + 1
    run(like.limit(0), number, folder, effect, key, most_tries)
    return number


def deliver(source: DataFrame, folder: str, checkpoint: str, effect: Effect, key: str = "event_key", seconds: int | None = 60, most_tries: int = MOST_TRIES):
    """Starts a query that does a run for each micro-batch of source, every so many seconds, or with None for what is there."""

    def batch(rows: DataFrame, number: int) -> None:
        run(rows, number * PER_BATCH, folder, effect, key, most_tries)

    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def outcomes(spark: SparkSession, like: DataFrame, folder: str, key: str = "event_key", most_tries: int = MOST_TRIES) -> DataFrame:
    """Every event of the ledger with its last run, tries before it, and status: sent, open (to come again) or given_up."""
    todo, attempts = _schemas(like.schema, key)
    runs = ended_runs(spark, folder)
    rows = _read(spark, folder, "todo", runs, todo).join(_read(spark, folder, "attempts", runs, attempts), [key, "run"])
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "run").alias("r")).select(key, "r.*")
    return last.withColumn("status", F.when(F.col("ok"), "sent").when(F.col("tries") + 1 < most_tries, "open").otherwise("given_up"))
