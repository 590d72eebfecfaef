"""Reading and writing the tables the library works on."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES_SCHEMA = "page_id BIGINT, url STRING, final_url STRING, html STRING"
# Kept where a page table has them: why a page wasn't fetched, and when it was.
OPTIONAL_PAGE_COLUMNS = ("reason", "crawled_at")
RESPONSES_SCHEMA = (
    "page_id BIGINT, url STRING, final_url STRING, status INT, content_type STRING, body BINARY, error STRING"
)
REQUESTS_SCHEMA = "site_id BIGINT, start_url STRING, options MAP<STRING,STRING>"
LOG_SCHEMA = "id BIGINT, ts TIMESTAMP, level STRING, logger STRING, message STRING"


def scan_pages(spark: SparkSession, path: str, format: str = "parquet", schema: str = PAGES_SCHEMA) -> DataFrame:
    """Stored pages; ``final_url`` is the requested URL where the table doesn't have it.

    The optional columns ``reason`` and ``crawled_at`` are kept; for a format without a schema of its
    own they must be named in ``schema``.
    """
    reader = spark.read.format(format)
    if format != "parquet":
        reader = reader.schema(schema)
    pages = reader.load(path)
    if "final_url" not in pages.columns:
        pages = pages.withColumn("final_url", F.col("url"))
    kept = [c for c in OPTIONAL_PAGE_COLUMNS if c in pages.columns]
    return pages.select("page_id", "url", F.coalesce("final_url", "url").alias("final_url"), "html", *kept)


def scan_responses(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    reader = spark.read.format(format)
    if format != "parquet":
        reader = reader.schema(RESPONSES_SCHEMA)
    return reader.load(path)


def read_requests(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Crawl requests: site_id, start_url and a map of options."""
    return spark.read.schema(REQUESTS_SCHEMA).format(format).load(path)


def read_option_file(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of options, as a one-row table with a map column ``options``.

    Values that aren't text, arrays too, are kept as their JSON text.
    """
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", "map<string,string>").alias("options"))


_RESULT_COLUMNS = ("site_id", "url", "part", "parts", "emails", "phones", "diagnostics")


def result_json(results: DataFrame, pretty: bool = False) -> DataFrame:
    """Result rows as JSON text, one object a site; characters stay as they are (no escapes)."""
    names = [c for c in _RESULT_COLUMNS if c in results.columns]
    options = {"pretty": "true"} if pretty else {}
    return results.select(F.to_json(F.struct(*names), options).alias("value"))


def write_results(results: DataFrame, path: str, format: str = "json") -> None:
    """Write result rows as JSON lines or parquet, one part file a task."""
    names = [c for c in _RESULT_COLUMNS if c in results.columns]
    results.select(*names).write.format(format).mode("errorifexists").save(path)


_STORED_RESULTS = "site_id BIGINT, value STRING, run STRING"
_MANIFEST = "run STRING, number BIGINT"


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).json(f"{folder}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def stage_results(results: DataFrame, folder: str) -> str:
    """Write the results of a run, as JSON text, where nobody reads them yet; gives the run's name."""
    run = uuid.uuid4().hex
    rows = results.select("site_id", F.to_json(F.struct(*[c for c in _RESULT_COLUMNS if c in results.columns])).alias("value"))
    rows.write.parquet(f"{folder}/rows/run={run}")
    return run


def commit_run(spark: SparkSession, folder: str, run: str) -> None:
    """Make a staged run the valid one for its sites; committing it again changes nothing.

    A commit is one line more in the manifest, in a file that Spark renames into place when it is whole.
    """
    manifest = _manifest(spark, folder)
    if manifest.where(F.col("run") == run).isEmpty():
        number = (manifest.agg(F.max("number")).first()[0] or 0) + 1
        spark.createDataFrame([(run, number)], _MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")


def commit_results(results: DataFrame, folder: str) -> str:
    """Store results so that a run may be repeated, or break, at any point.

    A run replaces the results of its own sites, all of them at once, and leaves other sites alone. A run
    that breaks before its commit leaves what was stored before; the next one needn't clean up.
    """
    run = stage_results(results, folder)
    commit_run(results.sparkSession, folder, run)
    return run


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """site_id and JSON ``value`` of the last committed run of each site; several rows for a site of several parts."""
    manifest = _manifest(spark, folder)
    try:
        rows = spark.read.schema(_STORED_RESULTS).parquet(f"{folder}/rows")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _STORED_RESULTS)
    committed = rows.join(manifest, "run")
    newest = committed.groupBy("site_id").agg(F.max(F.struct("number", "run")).alias("newest")).select("site_id", "newest.run")
    return committed.join(newest, ["site_id", "run"]).select("site_id", "value")
