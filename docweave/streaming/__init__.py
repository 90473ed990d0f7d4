"""Structured Streaming: incremental ingest, task status, day counts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.session import scratch_dir, ship

ACTIVE = ("uploading", "queued", "processing")


def parquet_stream(spark: SparkSession, sf_dir: str, table: str, files_at_once: int = 1) -> DataFrame:
    """A table's files as a stream, a few a trigger."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    local = path.removeprefix("file://")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path if os.path.isdir(local) else f"{sf_dir}/{table}.parque[t]")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read back what it wrote, from the shared folder. In update mode a later batch's rows come beside earlier ones, told apart by batch_id."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_id", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/batch={n}")  # a batch that runs again replaces itself

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    schema = stream.withColumn("batch_id", F.lit(0)).schema
    return spark.read.schema(schema).parquet(f"{base}/out/*")


def latest_status(tasks: DataFrame) -> DataFrame:
    """Of each task its latest status, on a batch or (update mode) a stream; late and repeated rows change nothing."""
    t = tasks.groupBy("task_id").agg(F.max(F.struct("ts", "status")).alias("m"), F.max(F.trim("sosok")).alias("sosok"), F.max(F.trim("site")).alias("site"), F.countDistinct("ts", "status").alias("events") if not tasks.isStreaming else F.lit(None).cast("long").alias("events"))
    return t.select("task_id", "sosok", "site", F.col("m.status").alias("status"), F.col("m.ts").alias("ts"), "events")


CHANGES = "channel string, task_id string, status string, ts timestamp, active boolean"


def channels(tasks: DataFrame) -> DataFrame:
    """Task events with the channel of their site; those without a site have none."""
    return tasks.where("site IS NOT NULL").withColumn("channel", F.concat_ws("_", F.trim("sosok"), F.trim("site"))).select("channel", "task_id", "status", "ts")


def status_changes(tasks: DataFrame, keep: str = "7 days") -> DataFrame:
    """The stream of changes (channel, task_id, status, ts, active): a row when a task's known latest status moves on.

    State is a row a task, so a busy site is no hot key. An event as old as the known one, or older, changes nothing; of events of one time the last by
    status counts. A task that has ended leaves the state ``keep`` after its end, in event time; the watermark is as late, so what comes for it afterwards is dropped.
    """
    open_for = int(milliseconds(keep))

    def each(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        status, at = state.get if state.exists else (None, -(2**62))
        rows = []
        events = pd.concat(list(frames)).sort_values(["ts", "status"]).drop_duplicates("ts", keep="last")
        for s, ts, us in zip(events["status"], events["ts"], events["us"], strict=True):
            if us > at:
                if s != status:
                    rows.append((*key, s, ts, s in ACTIVE))
                status, at = s, us
        state.update((status, at))
        if status not in ACTIVE:
            state.setTimeoutTimestamp(max(at // 1000 + open_for, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["channel", "task_id", "status", "ts", "active"])

    keyed = channels(tasks).withColumn("us", F.unix_micros("ts")).withWatermark("ts", keep)
    return keyed.groupBy("channel", "task_id").applyInPandasWithState(each, CHANGES, "status string, at bigint", "append", GroupStateTimeout.EventTimeTimeout)


def milliseconds(text: str) -> float:
    return pd.Timedelta(text).total_seconds() * 1000


def pushed(changes: DataFrame, send: Callable[[str, list[str]], None], checkpoint: str | None = None):
    """A writer of the changes to their channels: ``send(channel, frames)`` runs on the executors, once a channel and partition with its event frames in order of time."""

    def write(batch: DataFrame, _: int) -> None:
        frames = batch.withColumn("frame", F.to_json(F.struct(F.lit("task_update").alias("type"), "task_id", "status", "ts", "active")))

        def each(rows):
            by: dict[str, list[str]] = {}
            for r in rows:
                by.setdefault(r.channel, []).append(r.frame)
            for channel, out in by.items():
                send(channel, out)

        frames.repartition("channel").sortWithinPartitions("channel", "ts").select("channel", "frame").foreachPartition(each)

    w = changes.writeStream.foreachBatch(write)
    return w.option("checkpointLocation", checkpoint) if checkpoint else w


def channel_replies(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """What each command (channel, seq, type, task_id) is answered with: (channel, seq, reply, tasks), tasks as an array of (task_id, status, ts) by time, the latest first.

    ``ping`` is answered by ``pong``. ``dismiss_task`` takes one task off the channel's list, ``dismiss_all_completed`` all that have ended by then; ``refresh`` and the
    dismissals are answered by ``task_update`` and the list that is left. ``heartbeat`` (sent by a timer) is answered by the list only while a task is under way, else by ``ping``; an unknown type by nothing.
    A task dismissed stays off for later commands of the channel, in the order of seq.
    """
    known = channels(tasks).groupBy("channel", "task_id").agg(F.max(F.struct("ts", "status")).alias("m")).select("channel", "task_id", F.col("m.status").alias("status"), F.col("m.ts").alias("ts"))
    ended = ~F.col("t.status").isin(*ACTIVE)
    c, t = commands.alias("c"), known.alias("t")
    gone = c.where("c.type IN ('dismiss_task', 'dismiss_all_completed')").join(t, "channel").where(F.when(F.col("c.type") == "dismiss_task", F.col("c.task_id") == F.col("t.task_id")).otherwise(ended))
    gone = gone.groupBy("channel", F.col("t.task_id").alias("task_id")).agg(F.min("c.seq").alias("gone_at"))
    left = known.join(gone, ["channel", "task_id"], "left")
    asked = commands.where("type IN ('refresh', 'dismiss_task', 'dismiss_all_completed', 'heartbeat')").select("channel", "seq", "type")
    shown = asked.join(left, "channel").where(F.col("gone_at").isNull() | (F.col("gone_at") > F.col("seq")))
    lists = shown.groupBy("channel", "seq").agg(F.sort_array(F.collect_list(F.struct("ts", "task_id", "status")), asc=False).alias("l"), F.max(F.col("status").isin(*ACTIVE)).alias("busy"))
    out = commands.where("type IN ('ping', 'refresh', 'dismiss_task', 'dismiss_all_completed', 'heartbeat')").join(lists, ["channel", "seq"], "left")
    quiet = (F.col("type") == "heartbeat") & ~F.coalesce("busy", F.lit(False))
    reply = F.when(F.col("type") == "ping", "pong").when(quiet, "ping").otherwise("task_update")
    listed = F.transform(F.coalesce("l", F.array().cast("array<struct<ts: timestamp, task_id: string, status: string>>")), lambda x: F.struct(x.task_id.alias("task_id"), x.status.alias("status"), x.ts.alias("ts")))
    return out.select("channel", "seq", reply.alias("reply"), F.when(reply == "task_update", listed).alias("tasks"))


def uploads_per_day(tasks: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Uploads begun by day, in event time; days close once the watermark has passed them."""
    u = tasks.where("status = 'uploading'").withWatermark("ts", lateness)
    return u.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("uploads")).select(F.to_date("window.start").alias("day"), "uploads")


def landed_files(spark: SparkSession, path: str, archive: str | None = None, files_at_once: int = 1000) -> DataFrame:
    """The files that come into a folder as a stream of (file_id, path, length, modificationTime, content); with ``archive`` a file is moved there once its batch is done."""
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_at_once)
    r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive) if archive else r
    return r.load(path).select(F.substring_index("path", "/", -1).alias("file_id"), "path", "length", "modificationTime", "content")


def ingest_batch(parse: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None], report: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A batch function: files are parsed, good rows appended, and every file reported as done or failed; a bad file fails alone."""

    def each(batch: DataFrame, _: int) -> None:
        rows = parse(batch).persist()
        append(rows.where("error IS NULL"))
        report(rows.groupBy("file_id").agg(F.max("error").alias("message"), F.count(F.when(F.col("error").isNull(), 1)).alias("rows")).withColumn("status", F.when(F.col("message").isNull() & (F.col("rows") > 0), "success").otherwise("failed")))
        rows.unpersist()

    return each


def incremental_ingest(stored: DataFrame, parse: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None], report: Callable[[DataFrame], None]):
    """A stream of files through ``ingest_batch``."""
    return stored.writeStream.foreachBatch(ingest_batch(parse, append, report))


def sse_parts(lines: DataFrame) -> DataFrame:
    """The text of a model's event lines (stream_id, seq, line): what follows "data: ", up to [DONE], from the choice's delta; lines that aren't JSON are skipped."""
    d = lines.where(F.col("line").startswith("data: ")).withColumn("body", F.trim(F.substring("line", 7, 2**30)))
    end = d.where("body = '[DONE]'").groupBy("stream_id").agg(F.min("seq").alias("end"))
    d = d.join(end, "stream_id", "left").where("end IS NULL OR seq < end")
    delta = F.from_json("body", "choices ARRAY<STRUCT<delta: STRUCT<content: STRING, tool_calls: ARRAY<STRUCT<index: INT, function: STRUCT<name: STRING, arguments: STRING>>>>>>")
    return d.withColumn("delta", F.get(delta.choices, 0).delta).select("stream_id", "seq", F.col("delta.content").alias("content"), F.col("delta.tool_calls").alias("tool_calls"))


def tool_calls(parts: DataFrame) -> DataFrame:
    """Tool calls put together from their parts: a call is whole when its arguments are JSON; others are left out."""
    p = parts.select("stream_id", "seq", F.explode("tool_calls").alias("c"))
    args = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("c.function.arguments", F.lit("")).alias("a")))), lambda x: x.a), "")
    g = p.groupBy("stream_id", F.coalesce("c.index", F.lit(0)).alias("call")).agg(F.max("c.function.name").alias("name"), args.alias("arguments"))
    return g.where(F.try_parse_json("arguments").isNotNull())


ship(__name__)
