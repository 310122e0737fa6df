"""Streams of change rows merged into a table, batch by batch: as they come, or by their own order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwright.operators.merge import BROADCAST_BYTES, row_bytes, write_delta
from loomwright.plans.engine import Engine
from loomwright.sources.store import META, TRANSIENT, ConcurrentWrite


def stream_changes(engine: Engine, path: str, schema: StructType, model: str, keys: Sequence[str], action: str, checkpoint: str | None = None, files_per_batch: int = 1000, keep_versions: int = 2) -> int:
    """Merge what is new under a Parquet path into a model's table, and return the number of batches.

    Runs what is there and ends.  Each batch is a version of the table that carries the batch's number, so a batch that
    runs again after a loss is passed over; it writes its own rows and marks only, and is merged anew if another writer publishes
    first.  Of the versions outside the table's retention `keep_versions` stay.
    """
    relation = engine.relation(model, "table")
    place = checkpoint or f"{engine.store.root}/streams/{model}"
    label = f"loom.batch.{hashlib.md5(place.encode()).hexdigest()[:12]}"
    done: list[int] = []

    def once(batch: DataFrame, number: int) -> bool:
        entry = engine.store.entry(relation)
        if entry is None:
            raise ValueError(f"{model} has no table; run it first")
        properties = entry["properties"]
        if int(properties.get(label, -1)) >= number:
            return False
        config = json.loads(properties[META]) if META in properties else {}
        load = engine.store.stage(relation)
        try:
            delta = write_delta(engine.store, relation, entry, load, batch, keys, action, tracked=bool(config.get("change_tracking")))
            engine.store.publish(
                relation, load, StructType.fromJson(entry["schema"]), {**properties, label: str(number)}, False, entry.get("collation"), entry.get("comment", ""), entry.get("columns"),
                log=delta.log, base=entry, folders=delta.folders, marks=delta.marks, marked=delta.marked,
            )
        except Exception:
            engine.store.discard(load)
            raise
        engine.store.prune(relation, config.get("data_retention_time_in_days", 0), properties.get(TRANSIENT) == "true", keep_versions)
        return True

    def merge(batch: DataFrame, number: int) -> None:
        for attempt in range(engine.ATTEMPTS):
            try:
                if once(batch, number):
                    done.append(number)
                return
            except ConcurrentWrite:
                if attempt + 1 == engine.ATTEMPTS:
                    raise

    changes = engine.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    changes.writeStream.foreachBatch(merge).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return len(done)


#: Property of the time up to which a table has forgotten what was deleted.
HORIZON = "loom.horizon"


def newest(changes: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Of each key the change of greatest sequence; of several with the same one the greatest by its other columns."""
    rest = [c for c in changes.columns if c not in keys and c != sequence]
    best = F.max(F.struct(F.col(f"`{sequence}`"), *[F.col(f"`{c}`") for c in rest])).alias("__best")
    found = changes.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(best)
    return found.select(*[F.col(f"`{k}`") if k in keys else F.col(f"__best.`{k}`").alias(k) for k in changes.columns])


def ordered_steps(target: DataFrame, changes: DataFrame, keys: Sequence[str], action: str, sequence: str, time: str, horizon: int | None, forget: int | None) -> DataFrame:
    """What brings the table up to date with a batch: rows with __step (insert, update or delete).

    A change counts if its time is not before `horizon` and its sequence is greater than that of the key's row.  Deletes stay
    as rows, so that older changes that come later find them, until their time is before `forget`.
    """
    fresh = changes if horizon is None else changes.filter(F.col(f"`{time}`") >= horizon)
    last = newest(fresh, keys, sequence)
    size = last.agg(F.sum(row_bytes(last.select(*keys)))).first()[0] or 0
    asked = last.select(*[F.col(f"`{k}`") for k in keys]).alias("asked")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"held.`{k}`").eqNullSafe(F.col(f"asked.`{k}`"))
    held = target.alias("held").join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, on, "left_semi").select(*[F.col(f"`{k}`").alias(f"__held{i}") for i, k in enumerate(keys)], F.col(f"`{sequence}`").alias("__held"), F.lit(True).alias("__met"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__held{i}"))
    met = last.join(held, same, "left")
    step = F.when(F.col("__met").isNull(), F.lit("insert")).when(F.col(f"`{sequence}`") > F.col("__held"), F.lit("update"))
    names = [F.col(f"`{c}`") for c in target.columns]
    steps = met.withColumn("__step", step).filter("__step is not null").select(*names, "__step")
    if forget is None:
        return steps
    gone = target.filter((F.col(f"`{action}`") == "delete") & (F.col(f"`{time}`") < forget))
    mine = steps.select(*[F.col(f"`{k}`").alias(f"__held{i}") for i, k in enumerate(keys)])
    return steps.unionByName(gone.join(mine, same, "left_anti").select(*names, F.lit("delete").alias("__step")))


def stream_ordered(engine: Engine, path: str, schema: StructType, model: str, keys: Sequence[str], action: str, sequence: str, time: str, lateness: int, checkpoint: str | None = None, files_per_batch: int = 1000, keep_versions: int = 2) -> int:
    """Merge changes that come in any order, and more than once, by their own sequence; returns the number of batches.

    Of each key the change of greatest sequence holds, whichever batch it comes in: inserts and updates put its row, deletes
    take it away (see live_rows).  `time` is a whole number; changes more than `lateness` behind the latest time of the
    batches before are passed over, and deletes are forgotten when they are as old.  Each batch writes its own rows and marks only.
    The model's table has the columns of the changes.
    """
    relation = engine.relation(model, "table")
    place = checkpoint or f"{engine.store.root}/streams/{model}-ordered"
    label = f"loom.batch.{hashlib.md5(place.encode()).hexdigest()[:12]}"
    done: list[int] = []

    def once(batch: DataFrame, number: int) -> bool:
        entry = engine.store.entry(relation)
        if entry is None:
            raise ValueError(f"{model} has no table; run it first")
        properties = entry["properties"]
        if int(properties.get(label, -1)) >= number:
            return False
        seen = int(properties[HORIZON]) if HORIZON in properties else None
        latest = batch.agg(F.max(f"`{time}`")).first()[0]
        now = max(x for x in (seen, latest) if x is not None) if (seen, latest) != (None, None) else None
        horizon, forget = (None if x is None else x - lateness for x in (seen, now))
        load = engine.store.stage(relation)
        try:
            steps = ordered_steps(engine.store.rows(relation, entry), batch, keys, action, sequence, time, horizon, forget)
            delta = write_delta(engine.store, relation, entry, load, steps, keys, "__step")
            held = {**properties, label: str(number), **({} if now is None else {HORIZON: str(now)})}
            engine.store.publish(
                relation, load, StructType.fromJson(entry["schema"]), held, False, entry.get("collation"), entry.get("comment", ""), entry.get("columns"),
                base=entry, folders=delta.folders, marks=delta.marks, marked=delta.marked,
            )
        except Exception:
            engine.store.discard(load)
            raise
        engine.store.prune(relation, 0, True, keep_versions)
        return True

    def merge(batch: DataFrame, number: int) -> None:
        for attempt in range(engine.ATTEMPTS):
            try:
                if once(batch, number):
                    done.append(number)
                return
            except ConcurrentWrite:
                if attempt + 1 == engine.ATTEMPTS:
                    raise

    changes = engine.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    changes.writeStream.foreachBatch(merge).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return len(done)


def live_rows(engine: Engine, model: str, action: str) -> DataFrame:
    """The rows of an ordered stream's table without the deletes that are remembered."""
    return engine.ref(model).filter(F.coalesce(F.col(f"`{action}`") != "delete", F.lit(True)))
