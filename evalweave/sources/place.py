"""Where a run's own files go: below spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder. Where spark.checkpoint.dir is unset a local folder stands in, if all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="evalweave-")
        spark.conf.set("spark.checkpoint.dir", where)
    where = where.rstrip("/") if "://" in where else "file://" + where.rstrip("/")
    return f"{where}/evalweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
