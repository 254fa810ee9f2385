"""Making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch where the session keeps Spark's default of 64 MB: whole documents are large rows.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors through Spark's own file server, once a Spark application.

    Needed before any Python function of the package runs in a task, unless the package is installed there. Where the
    session keeps the default bound of an Arrow batch, this sets a lower one, once.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, BATCH_BYTES)
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tokenlake-"), "tokenlake_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
