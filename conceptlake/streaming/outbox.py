"""Change delivery: an append-only outbox read as a stream, with leases and idempotent acknowledgement."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from conceptlake.errors import Duplicate, InvalidParameter, NotFound, bounded

EVENT = "event_id long, bundle_id long, operation string, concept_id string, at_us long, causation string"
#: The operations that a producer may name.
OPERATIONS = ("refresh_bundle", "put_document", "delete_document", "concept_change")


@dataclass(frozen=True)
class Context:
    """What a producer says about a change: an event carries it. ``causation_key`` keeps dependencies that were registered
    with the same key from being triggered again."""

    origin: str | None = None
    causation_key: str | None = None
    reconciliation_key: str | None = None
    producer: str | None = None
    manifest_hash: str | None = None
    observed_source_generation: str | None = None
    operation: str | None = None

    @classmethod
    def of(cls, raw: str | dict | None) -> Context:
        """From a JSON object, or its text; other keys are passed over, and what is no text is its JSON. Blank: none."""
        if raw is None or (isinstance(raw, str) and not raw.strip()):
            return cls()
        try:
            given = json.loads(raw) if isinstance(raw, str) else raw
        except json.JSONDecodeError as e:
            raise InvalidParameter(f"the context is not JSON: {e}") from e
        if not isinstance(given, dict):
            raise InvalidParameter("the context must be a JSON object")
        said = {k: given[k] for k in cls.__dataclass_fields__ if given.get(k) is not None}
        out = cls(**{k: v if isinstance(v, str) else json.dumps(v) for k, v in said.items()})
        if out.operation is not None and out.operation not in OPERATIONS:
            raise InvalidParameter(f"the context's operation must be one of {OPERATIONS}, not {out.operation!r}")
        return out


def sync_event(diff: DataFrame, event_id: int, bundle_id: int, at_us: int, context: Context | None = None) -> DataFrame:
    """The one event of a sync: its context, how many files were added, updated and removed, and how many there are now.

    ``diff`` has a row a file with its ``change``; one aggregation with map-side counts.
    """
    context = context or Context()
    counts = [F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "updated", "removed")]
    total = F.count(F.when(F.col("change") != "removed", 1)).alias("total")
    said = {k: v for k, v in asdict(context).items() if k not in ("operation", "causation_key")}
    text = lambda v: F.lit(v).cast("string")
    head = [F.lit(event_id).cast("long").alias("event_id"), F.lit(bundle_id).cast("long").alias("bundle_id"), text(context.operation or OPERATIONS[0]).alias("operation"), text(None).alias("concept_id"), F.lit(at_us).cast("long").alias("at_us"), text(context.causation_key).alias("causation")]
    return diff.agg(*counts, total).select(*head, *[text(v).alias(k) for k, v in said.items()], "added", "updated", "removed", "total")


def notifications(events: DataFrame, channel: str) -> DataFrame:
    """(channel, payload) for events of syncs: a hint to look into the outbox, as JSON. Without a channel there are none."""
    payload = F.to_json(F.struct("bundle_id", F.col("operation").alias("op"), "added", "updated", "removed", "total", "event_id"))
    rows = events.select(F.lit(channel).alias("channel"), payload.alias("payload"))
    return rows if channel else rows.where(F.lit(False))


def notify(stream: DataFrame, channel: str, send: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give ``send`` the notifications of each micro-batch (to write to a topic, a folder or a webhook)."""
    return deliver(notifications(stream, channel), send, checkpoint, once)


def append(events: DataFrame, path: str) -> None:
    """Add events; files only ever join the folder, so readers may stream it."""
    events.write.mode("append").parquet(path)


def read_stream(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).parquet(path)


def deliver(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Give ``handle`` each micro-batch with its number; the checkpoint makes a repeated batch carry the same number."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def latest_per_concept(stream: DataFrame) -> DataFrame:
    """State of each concept over the stream: its newest event."""
    return stream.groupBy("bundle_id", "concept_id").agg(F.max_by(F.struct("event_id", "operation", "at_us"), "event_id").alias("e")).select("bundle_id", "concept_id", "e.*")


def claim(events: DataFrame, consumer: str, now: int, lease_s: int = 60, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(claimed, table after): the oldest events that are pending or whose claim has run out.

    ``events`` has claimed_by, claimed_until, attempts, acked beside its key event_id.
    """
    bounded("limit", limit, 1, 1000)
    bounded("lease_s", lease_s, 1, 86_400)
    free = ~F.col("acked") & (F.col("claimed_until").isNull() | (F.col("claimed_until") <= now))
    taken = events.where(free).orderBy("event_id").limit(limit).select("event_id").withColumn("__t", F.lit(True))
    after = events.join(taken, "event_id", "left")
    hit = F.coalesce("__t", F.lit(False))
    after = after.withColumn("claimed_by", F.when(hit, F.lit(consumer)).otherwise(F.col("claimed_by"))).withColumn("claimed_until", F.when(hit, F.lit(now + lease_s)).otherwise(F.col("claimed_until"))).withColumn("attempts", F.col("attempts") + hit.cast("int"))
    return after.where(hit).drop("__t").orderBy("event_id"), after.drop("__t")


def acknowledge(events: DataFrame, event_id: int, consumer: str, key: str) -> DataFrame:
    """Mark an event as accepted. The same key again changes nothing; another key or a foreign claim is an error."""
    row = events.where(F.col("event_id") == event_id).limit(1).collect()
    if not row:
        raise NotFound(f"no event {event_id}")
    if row[0]["acked"]:
        if row[0]["ack_key"] != key:
            raise Duplicate("the event was acknowledged with another key")
        return events
    if row[0]["claimed_by"] != consumer:
        raise NotFound("the event isn't claimed by this consumer")
    hit = F.col("event_id") == event_id
    return events.withColumn("acked", F.col("acked") | hit).withColumn("ack_key", F.when(hit, key).otherwise(F.col("ack_key")))


def prune(events: DataFrame, older_than_us: int) -> DataFrame:
    """Without acknowledged events older than the retention."""
    return events.where(~(F.col("acked") & (F.col("at_us") < older_than_us)))


def pending(events: DataFrame) -> DataFrame:
    """Events that wait; ``claim`` takes the oldest."""
    return events.where(~F.col("acked"))


def watch(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """Files of a bundle as a stream (path, content): new ones join as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "content")


def read_pushed(spark: SparkSession, path: str) -> DataFrame:
    """Pushed events: JSON lines that a receiver has written."""
    return spark.readStream.schema(EVENT).json(path)
