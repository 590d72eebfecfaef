"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings for a local run; a cluster brings its own master, memory and checkpoint folder.
LOCAL_SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python call site of every expression would double the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(master: str = "local[*]", name: str = "reachmap", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**LOCAL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Temporary folders of sessions of one process, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    Where the setting is missing, a session of one process (``local[...]``) gets a temporary folder;
    anything with executors of its own must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="reachmap-")
        folder = _LOCAL_FOLDERS[context.applicationId]
    return folder.rstrip("/")


def new_run_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for the tables one run writes."""
    return f"{shared_folder(spark)}/reachmap-{label}-{uuid.uuid4().hex}"
