"""Continuous ingestion: what lands under a folder becomes chunks, document versions and dead letters.

Three streams read the same files, each with its own checkpoint and file sink,
so a batch that is killed runs again without a row twice.  None of them reads
what was written before:

* ``versions`` appends a narrow row for each delivery of a document, without a
  hash where its text is not valid;
* ``chunks`` keeps the hashes of contents in a RocksDB state store, in which
  they expire ``keep`` after they came, and cuts contents that it does not know;
* ``dead_letters`` appends what fails a stage, with stage and reason.

A document that comes again with another text gets a new version, and one whose
latest text is not valid has none any more; readers (``documents``,
``chunk_table``) take the latest version of each document and the chunks of the
contents that these name.  A content of which cleaning leaves nothing is a
version without chunks, and a dead letter.  A content that comes again after
its state has expired is cut again, and readers take its first copy.

The time of a delivery is that of its batch, which a rerun repeats, so nothing
is ever late; deliveries of one batch are ordered by their files' times.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.text import clean
from lodestone.operators.chunk import windows

#: Characters of the shortest text that is taken in.
LEAST = 20
#: Columns of what the sinks hold; a sink may have no file yet.
HELD = {"dead_letters": "doc_id long, stage string, reason string, arrived timestamp", "versions": "doc_id long, content_hash string, arrived timestamp, landed timestamp", "chunks": "content_hash string, arrived timestamp, chunk_index int, char_start int, chunk string"}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fault(doc_id: Column, text: Column, least: int = LEAST) -> Column:
    """``struct(stage, reason)``: the first stage that a document fails, null if none."""
    n = F.coalesce(F.length(text), F.lit(0))

    def failed(stage: str, *reason: str | Column) -> Column:
        parts = [F.lit(r) if isinstance(r, str) else r.cast("string") for r in reason]
        return F.struct(F.lit(stage).alias("stage"), F.concat(*parts).alias("reason"))

    return (
        F.when(doc_id.isNull(), failed("parse-validate", "Missing parsed externalId"))
        .when(n < least, failed("parse-validate", "Parsed text too short (", n, f" < {least})"))
        .when(clean(text) == "", failed("chunk", "Chunking produced zero chunks"))
    )


def clean_batch(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, content_hash, text``: valid documents in clean form and whole, the smallest id of equal texts; only chunks have a length limit, that of ``windows``."""
    rows = docs.filter(fault(F.col("doc_id"), F.col("text"), least).isNull()).select("doc_id", F.sha2("text", 256).alias("content_hash"), clean(F.col("text")).alias("text"))
    return rows.groupBy("content_hash").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.doc_id", "content_hash", "d.text")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def deliveries(spark: SparkSession, source: str, schema: StructType, files_per_batch: int | None) -> DataFrame:
    """New rows under ``source`` with the batch's time and the file's."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(source).select("doc_id", "text", F.current_timestamp().alias("arrived"), F.col("_metadata.file_modification_time").alias("landed"))


def sinks(rows: DataFrame, keep: str, least: int = LEAST) -> dict[str, DataFrame]:
    """What each sink is fed with."""
    marked = rows.withColumn("fault", fault(F.col("doc_id"), F.col("text"), least))
    valid = marked.filter("fault is null").withColumn("content_hash", F.sha2("text", 256))
    hashed = F.when(F.coalesce(F.col("fault.stage") != "parse-validate", F.lit(True)), F.sha2("text", 256))
    # only hashes that the state does not hold go on, so that known contents are not cleaned
    fresh = valid.select("content_hash", "arrived", "text").withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["content_hash"])
    return {
        "dead_letters": marked.filter("fault is not null").select("doc_id", "fault.stage", "fault.reason", "arrived"),
        "versions": marked.filter("doc_id is not null").select("doc_id", hashed.alias("content_hash"), "arrived", "landed"),
        "chunks": windows(fresh.withColumn("text", clean(F.col("text")))),
    }


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_per_batch: int | None = None, keep: str = "30 days") -> None:
    """Read what is new under ``source`` since the last run (kept in ``checkpoint``) into ``target`` and end."""
    with state_store(spark):
        running = [
            fed.writeStream.format("parquet").outputMode("append").option("path", f"{target}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
            for name, fed in sinks(deliveries(spark, source, schema, files_per_batch), keep).items()
        ]
    for query in running:
        query.awaitTermination()


def held(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.schema(HELD[name]).parquet(f"{target}/{name}")


def documents(spark: SparkSession, target: str) -> DataFrame:
    """``doc_id, content_hash, arrived``: the latest version of each document; none if its latest delivery is not valid."""
    latest = F.max(F.struct("arrived", "landed", "content_hash")).alias("v")
    return held(spark, target, "versions").groupBy("doc_id").agg(latest).select("doc_id", "v.content_hash", "v.arrived").filter("content_hash is not null")


def chunk_table(spark: SparkSession, target: str) -> DataFrame:
    """``content_hash, chunk_index, char_start, chunk`` of the contents that documents have now.

    Hashes and times alone decide which, so the chunks' texts meet one narrow table.
    """
    written = held(spark, target, "chunks")
    first = written.groupBy("content_hash").agg(F.min("arrived").alias("arrived"))
    now = documents(spark, target).select("content_hash").distinct()
    return written.join(first.join(now, "content_hash", "left_semi"), ["content_hash", "arrived"], "left_semi").drop("arrived")


def dead_letters(spark: SparkSession, target: str) -> DataFrame:
    """``doc_id, stage, reason, attempts, arrived``: what failed, how often and when last."""
    rows = held(spark, target, "dead_letters")
    return rows.groupBy("doc_id", "stage", "reason").agg(F.count(F.lit(1)).alias("attempts"), F.max("arrived").alias("arrived"))
