"""Helpers the operators share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = bytes.maketrans(A_Z.encode(), A_Z.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()
_own: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that they need no path of their own to it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(), "tallyframe.zip")
        with zipfile.ZipFile(name, "w") as out:
            for folder, _, files in os.walk(top):
                for f in files:
                    if f.endswith(".py"):
                        out.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
        context.addPyFile(name)  # Spark serves it from the driver
        _shipped.add(context.applicationId)


def checkpoint_setting(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is not set a folder of its own is made if all tasks run in this process; on a cluster that is refused."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        place = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="checkpoints-"))
    return place


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's checkpoints under checkpoint_setting. Spark removes a checkpoint with its DataFrame
    if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_setting(spark))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, with no lineage before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it differ from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fingerprint(text):
    """A 64-bit hash of a text as it is, which with doc_id tells rows apart whose ids repeat."""
    return F.xxhash64(text.cast("string"))


def ascii_lower(c):
    """A-Z lower-cased and nothing else."""
    return F.translate(c, A_Z, A_Z.lower())


def crc32_of_id(c):
    """crc32 of an id written as decimal text."""
    return F.crc32(c.cast("string").cast("binary"))
