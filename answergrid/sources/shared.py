"""The folder that all machines of a cluster share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a folder in the warehouse, and the setting is made, so that all that
    follows agrees.  A warehouse on the disk of one machine will do only where that machine
    runs all tasks; on a cluster it is an error.
    """
    named = spark.conf.get(SETTING, None)
    if not named:
        context, warehouse = spark.sparkContext, spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        system = context._jvm.org.apache.hadoop.fs.Path(warehouse).getFileSystem(context._jsc.hadoopConfiguration())
        if system.getUri().getScheme() == "file" and not re.match(r"local(\[|$)", context.master):
            raise ValueError(f"{SETTING} must name a folder that all machines share; the warehouse {warehouse} is on one")
        named = f"{warehouse}/_shared"
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{unique()}"


def unique() -> str:
    """A name that nothing else has."""
    return uuid.uuid4().hex
