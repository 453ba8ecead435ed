"""The package on executors: tasks that run its functions import it from a zip that Spark hands out."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors of the session, once an application; they need no path of the driver's."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ledgerloom-")), "ledgerloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _done.add(app)
