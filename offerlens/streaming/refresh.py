"""The refresh stream: check events in, each record's state out; and the last status of a key.

State is one small row for each record, in the state store; a micro-batch touches only the records that it has
events of. The transition is the sequential rule; the batch form in operators.registry is its closed form.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from offerlens.operators.registry import ALPHA, PARK_AFTER

STATE = "checkCount long, successCount long, consecutiveMisses long, dealDensity double, changeRate double, status string"
OUT = f"record_id long, {STATE}"


def step(s: tuple, kind: str, density: float, changed: bool) -> tuple:
    """The record's state after one check."""
    checks, oks, misses, deal, change, status = s
    if kind == "blocked":
        return s
    checks += 1
    if kind == "miss":
        misses += 1
        return checks, oks, misses, deal, change, "parked" if misses >= PARK_AFTER else "stale" if status == "active" else status
    deal = density if checks == 1 else ALPHA * density + (1 - ALPHA) * deal
    change = ALPHA * float(changed) + (1 - ALPHA) * change
    return checks, oks + 1, 0, deal, change, "active"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = state.get if state.exists else (0, 0, 0, 0.0, 0.0, "candidate")
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    for r in rows.itertuples():
        s = step(s, r.kind, r.density, r.changed)
    state.update(s)
    yield pd.DataFrame([(key[0], *s)], columns=["record_id", *(c.split()[0] for c in STATE.split(", "))])


def refresh_states(checks: DataFrame) -> DataFrame:
    """Updates of the records' states from a stream of checks, in event-time order within a micro-batch."""
    return checks.groupBy("record_id").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _shared(spark: SparkSession) -> str:
    """A folder of the stream's own; a local master alone may go without spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _drain(stream: DataFrame, spark: SparkSession, mode: str, key: list[str]) -> DataFrame:
    """Run over what there is; the updates are written batch by batch, the last of each key is the result."""
    where = _shared(spark)

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_", F.lit(n)).write.mode("overwrite").parquet(f"{where}/out/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    rows = spark.read.parquet(f"{where}/out/*")
    return rows.groupBy(key).agg(*(F.max_by(c, "batch_").alias(c) for c in rows.columns if c not in (*key, "batch_", "batch")))


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "signup", "miss").when(F.col("event_type") == "error", "blocked").otherwise("ok")
    checks = e.select(F.col("user_id").alias("record_id"), "ts", "event_id", kind.alias("kind"), (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("density"), (F.col("event_type") == "view").alias("changed"))
    return _drain(refresh_states(checks), spark, "update", ["record_id"])


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each key, in update mode."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def latest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(latest_status(_events(spark, sf_dir)), spark, "update", ["user_id"])


def due_on_tick(registry: DataFrame, now: int, check, cap: int = 5) -> DataFrame:
    """One tick, for foreachBatch: the due set, checked by `check` (DataFrame to DataFrame with `changed`),
    of which only changed pages go on."""
    from offerlens.operators.registry import due

    return check(due(registry, now, cap)).where("changed")


def paused_until(failures: DataFrame, least: int = 3, pause_ms: int = 900_000) -> DataFrame:
    """From runs of failures (since, failures), when the refresh may go on."""
    return failures.where(F.col("failures") >= least).select((F.unix_millis(F.col("since").cast("timestamp")) + pause_ms).alias("until"))
