"""Make the package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
import threading
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_one_at_a_time = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Spark distributes the archive; the driver only needs a place to build it.
    """
    sc = spark.sparkContext
    # Fits that run side by side ask for it from threads of their own.
    with _one_at_a_time:
        if sc.applicationId in _shipped:
            return
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="flowsieve-package-")) / package.name
        sc.addPyFile(shutil.make_archive(str(target), "zip", root_dir=package.parent, base_dir=package.name))
        _shipped.add(sc.applicationId)
