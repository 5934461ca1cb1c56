"""Structured Streaming jobs over an events source: windows, sessions, deduplication, dead letters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "10 minutes"


def shared(spark: SparkSession) -> str:
    """The folder that all executors see, for checkpoints and sinks."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a file stream with its own schema."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def decode(stream: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Envelope records from JSON text; a record that is no JSON of the schema has a null id."""
    return stream.select(F.from_json(F.col(value).cast("string"), schema).alias("e"), F.col(value).alias("raw")).select("e.*", "raw")


def tumbling(stream: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by type and event-time window; rows later than the watermark go."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = stream.withWatermark("ts", LATENESS).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user, closed by a gap."""
    g = stream.withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def deduplicated(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark([key])


ENVELOPE = "type string, tenant string, priority string, id long"


def encoded(stream: DataFrame, kind: str, tenant: str, priority: Column, key: str = "event_id") -> DataFrame:
    """(topic, key, value, headers) of events as a Kafka sink takes them: the topic by type, the key by tenant, so that a tenant's events keep their order."""
    body = F.to_json(F.struct(F.col(kind).alias("type"), F.col(tenant).cast("string").alias("tenant"), priority.alias("priority"), F.col(key).cast("long").alias("id")))
    headers = F.array(F.struct(F.lit("priority").alias("key"), F.encode(priority, "utf-8").alias("value")))
    return stream.select(F.col(kind).alias("topic"), F.col(tenant).cast("string").cast("binary").alias("key"), body.cast("binary").alias("value"), headers.alias("headers"))


def dispatched(envelopes: DataFrame, kinds: list[str]) -> DataFrame:
    """(topic, key, priority) of decoded envelopes of the kinds that have a handler; the others are nobody's."""
    return envelopes.where(F.col("type").isin(kinds)).select(F.col("type").alias("topic"), F.col("tenant").alias("key"), "priority")


def from_kafka(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """Records of topics as a stream (key, value, headers, timestamp). Needs Spark's Kafka package."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("includeHeaders", "true").load()


def to_kafka(records: DataFrame, servers: str, checkpoint: str):
    """Starts the sink for encoded() records."""
    return records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").option("checkpointLocation", checkpoint).start()


def discovered_files(changes: DataFrame) -> DataFrame:
    """(url, source_id, discovered, event_name) from changes of a file system (path, changed, event_name)."""
    return changes.select(F.concat(F.lit("file://"), F.col("path")).alias("url"), F.lit("filesystem").alias("source_id"), F.col("changed").alias("discovered"), "event_name")


def discovered_s3(changes: DataFrame) -> DataFrame:
    """As discovered_files(), from changes of an object store (bucket, object, changed, event_name)."""
    return changes.select(F.concat(F.lit("s3://"), F.col("bucket"), F.lit("/"), F.col("object")).alias("url"), F.concat(F.lit("s3-"), F.col("bucket")).alias("source_id"), F.col("changed").alias("discovered"), "event_name")


def discovered_rows(changes: DataFrame) -> DataFrame:
    """As discovered_files(), from changes of a table whose new values (a map) hold url and source_id."""
    return changes.select(F.col("new")["url"].alias("url"), F.col("new")["source_id"].alias("source_id"), F.col("changed").alias("discovered"), F.col("operation").alias("event_name"))


def processed(files: DataFrame, error: Column, tries: int) -> DataFrame:
    """files with event (file.completed or file.failed), error and the tries it took: a failing one is tried `tries` times. A pure expression fails alike each time, so it is evaluated once."""
    return files.withColumn("error", error).withColumns({"event": F.when(F.col("error").isNull(), "file.completed").otherwise("file.failed"), "tries": F.when(F.col("error").isNull(), 1).otherwise(tries)})


def retained(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Rows of the last `seconds` before the newest one."""
    newest = F.broadcast(df.agg(F.max(ts).alias("_newest")))  # one row
    t = F.col(ts).cast("timestamp")
    return df.crossJoin(newest).where(F.unix_micros(t) > F.unix_micros(F.col("_newest").cast("timestamp")) - seconds * 1_000_000).drop("_newest")


def running_profiles(stream: DataFrame, user: str = "user_id", value: str = "value") -> DataFrame:
    """(user, n, mean) after each batch of a user's events, the sums carried as state; null values count as events but not in the mean."""
    import pandas as pd

    def step(key, frames, state):
        n, filled, total = state.get if state.exists else (0, 0, 0.0)
        for f in frames:
            n, filled, total = n + len(f), filled + int(f[value].count()), total + float(f[value].sum())
        state.update((n, filled, total))
        yield pd.DataFrame({user: [key[0]], "n": [n], "mean": [total / filled if filled else None]})

    kind = dict(stream.dtypes)[user]
    return stream.select(user, value).groupBy(user).applyInPandasWithState(step, f"{user} {kind}, n long, mean double", "n long, filled long, total double", "update", "NoTimeout")


def latest(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Runs a stream in update mode and reads the last row of each key."""
    out = collected(stream, "update")
    names = [c for c in out.columns if c != key]
    return out.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in names])


def collected(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and reads its result: a batch replaces the table in complete mode, else it writes a folder of its own, by its
    number, so that a batch run anew after a restart adds no row twice."""
    spark = stream.sparkSession
    base = f"{shared(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{base}/out")
        else:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema).option("recursiveFileLookup", "true")
    return out.parquet(f"{base}/out")


def split_dead_letters(stream: DataFrame, bad: Column, topic: str, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """Good rows, and dead letters with headers (topic, error, tries): rows that hold `bad`, or for which it is null, after `tries` attempts.

    Each batch writes a folder of its own, by its number, so that a batch run anew adds no row twice."""
    spark = stream.sparkSession
    base = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    headers = F.map_from_arrays(F.array(F.lit("topic"), F.lit("error"), F.lit("tries")), F.array(F.col(topic).cast("string"), F.when(bad.isNull(), "malformed").otherwise("rejected"), F.lit(str(tries))))

    def save(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("dead", F.coalesce(bad, F.lit(True)))
        marked = marked.withColumn("headers", F.when(F.col("dead"), headers))
        marked.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return out.where("not dead").drop("dead", "headers"), out.where("dead").drop("dead")
