"""Prepare a session for tasks in Python: code on the workers, small Arrow batches."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH_ROWS = "1000"
PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Once a session: zip the package on the driver and let Spark fetch it to every worker (``addPyFile``).

    Rows hold whole texts, so an Arrow batch of the default 10,000 rows is tens of MB on
    both sides of each worker; ``BATCH_ROWS`` bounds it.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_tallyspark_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-code-"), "tallyspark.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
    sc._tallyspark_shipped = True
