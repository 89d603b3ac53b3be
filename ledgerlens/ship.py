"""The package as a file that Spark sends to its executors: functions that run in Python there are imported by name."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once a session; where executors have it on their path already, theirs stays first."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-"), "ledgerlens-package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(here)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def reachable(spark: SparkSession) -> None:
    """The package for Python that Spark starts on the driver's own machine, as it does to set up a stateful operator: files that are
    sent to executors do not reach it."""
    parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if parent not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, parent]))
