"""What driver and executors share: a folder, and this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import EngineError


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a local one, if all executors are threads of this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise EngineError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="loomwork-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application; they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package, folder = Path(__file__).resolve().parent.parent, Path(tempfile.mkdtemp(prefix="loomwork-")).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # until then the driver serves it
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    _shipped.add(context.applicationId)
