"""Folders for data in between, on storage that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where all runs in one local process."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="fluxlens-")


def new_folder(spark: SparkSession, stem: str) -> str:
    """Path of a folder of its own that doesn't exist yet."""
    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"
