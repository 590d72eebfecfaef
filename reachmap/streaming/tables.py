"""The same extraction on streams of stored pages and responses."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import normalize_url, normalized_site_key
from ..operators.contacts import contact_rows, page_contacts
from ..operators.responses import OK, classify_responses
from ..sources.tables import PAGES_SCHEMA, RESPONSES_SCHEMA

CRAWLED_AT = ", crawled_at TIMESTAMP"


def stream_pages(spark: SparkSession, path: str, format: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Pages as they are stored, from a folder of files."""
    reader = spark.readStream.schema(PAGES_SCHEMA + CRAWLED_AT).option("maxFilesPerTrigger", files_per_batch)
    return reader.format(format).load(path)


def stream_responses(spark: SparkSession, path: str, format: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(RESPONSES_SCHEMA + CRAWLED_AT).option("maxFilesPerTrigger", files_per_batch)
    return reader.format(format).load(path)


# The trigger of the runners below unless they are given one: all files present, then stop. With
# another, such as ``{"processingTime": "1 minute"}``, a runner returns when its query is stopped.
ALL_PRESENT = {"availableNow": True}


def with_site_key(pages: DataFrame) -> DataFrame:
    """Key pages by site and normalised URL; pages with unusable URLs are dropped."""
    keyed = pages.withColumn("url", normalize_url("url", True)).where(F.col("url").isNotNull())
    return keyed.withColumn("site_key", normalized_site_key("url"))


def dedupe_pages(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each normalised URL once, as far as the watermark reaches back; state stays bounded.

    The page itself (``html``) is left out: only narrow rows are shuffled and kept in state. Join
    or extract before, as ``contacts_once`` does.
    """
    narrow = with_site_key(pages.drop("html") if "html" in pages.columns else pages)
    return narrow.withWatermark("crawled_at", delay).dropDuplicatesWithinWatermark(["site_key", "url"])


def contacts_once(pages: DataFrame, delay: str = "1 day", **options) -> DataFrame:
    """Contact rows of each normalised URL once: contacts are read first, then narrow rows deduped."""
    found = page_contacts(with_site_key(pages), **options).withWatermark("crawled_at", delay)
    return contact_rows(found.dropDuplicatesWithinWatermark(["site_key", "url"]))


def contacts_stream(pages: DataFrame, **options) -> DataFrame:
    """Contact rows of each page: a stateless projection, as in batch."""
    return contact_rows(page_contacts(with_site_key(pages), **options))


def failure_counts(responses: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Failed responses by hour and reason."""
    failed = classify_responses(responses).where(F.col("reason") != OK)
    counted = failed.withWatermark("crawled_at", delay).groupBy(F.window("crawled_at", window), "reason").count()
    return counted.select(
        F.col("window.start").alias("window_start"), "reason", F.col("count").alias("n_pages")
    )


def run_to_table(stream: DataFrame, folder: str, trigger: dict | None = None) -> DataFrame:
    """Run an append stream over all files present and read what it stored."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(**(trigger or ALL_PRESENT))
        .start(f"{folder}/rows")
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB: on the executors' disks, not in their heaps."""
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STATE_STORE, before) if before else spark.conf.unset(_STATE_STORE)


_CONTACT_KEY = ("site_key", "kind", "contact")
_STORED_CONTACTS = "site_key STRING, kind STRING, contact STRING, batch BIGINT"


def start_site_contacts(contact_stream: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the distinct contacts of each site in a growing table of batches, under ``folder``/rows.

    What is stored already is streaming state keyed by (site, kind, contact): a batch looks up its own
    contacts only, so its cost doesn't grow with what earlier batches stored, and a site with very many
    contacts is spread over all state partitions. The state is as large as the distinct contacts, on the
    executors' disks, with changes saved in the checkpoint. A repeated batch starts from the state
    before it and replaces its own rows.
    """
    rows = f"{folder}/rows"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    new = contact_stream.select(*_CONTACT_KEY).dropDuplicates([*_CONTACT_KEY])
    with _state_on_disk(contact_stream.sparkSession):
        return (
            new.writeStream.foreachBatch(store)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or ALL_PRESENT))
            .start()
        )


def run_site_contacts(contact_stream: DataFrame, folder: str, trigger: dict | None = None) -> DataFrame:
    """``start_site_contacts`` until it ends; site_key, kind, contact and the batch that brought them."""
    start_site_contacts(contact_stream, folder, trigger).awaitTermination()
    return contact_stream.sparkSession.read.schema(_STORED_CONTACTS).parquet(f"{folder}/rows")


def contact_counts(contact_stream: DataFrame) -> DataFrame:
    """Rows that showed each contact so far, and the first and last time; for ``run_counts``."""
    return contact_stream.groupBy(*_CONTACT_KEY).agg(
        F.count(F.lit(1)).alias("n_pages"), F.min("crawled_at").alias("first_seen"), F.max("crawled_at").alias("last_seen")
    )


class Split(NamedTuple):
    """Rows of a stream by whether they came in time, each with the ``batch`` that brought them."""

    kept: DataFrame
    late: DataFrame


def run_split_late(stream: DataFrame, folder: str, delay: str = "2 hours", time: str = "crawled_at", trigger: dict | None = None) -> Split:
    """Put rows that come more than ``delay`` after newer ones into a table of their own.

    Spark's watermark drops such rows without a trace. Here the mark of a batch is the newest time of all
    batches before it, less ``delay``: rows older than that are late, others (and those without a time) are
    kept. Each batch writes the newest time so far as one row, so the next one reads one row and nothing
    else is remembered, however long the stream runs. A repeated batch replaces its own rows.
    """
    spark = stream.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        before = f"{folder}/marks/batch={number - 1}"
        newest = F.lit(spark.read.schema("newest BIGINT").parquet(before).first().newest if number else None).cast("bigint")
        mark = F.timestamp_micros(newest) - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(time) < mark, F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        so_far = batch.agg(F.greatest(F.unix_micros(F.max(time)), newest).alias("newest"))
        so_far.write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or ALL_PRESENT))
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return Split(*(spark.read.schema(schema).parquet(f"{folder}/{name}") for name in Split._fields))


def run_counts(counts: DataFrame, keys: list[str], folder: str, trigger: dict | None = None) -> DataFrame:
    """Run an aggregating stream in update mode; the latest row of each key is the result."""
    rows = f"{folder}/rows"
    spark = counts.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    with _state_on_disk(spark):
        query = (
            counts.writeStream.foreachBatch(store)
            .outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or ALL_PRESENT))
            .start()
        )
    query.awaitTermination()
    values = [c for c in counts.columns if c not in keys]
    stored = spark.read.option("basePath", rows).parquet(rows)
    latest = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
