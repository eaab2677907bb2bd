"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.scan import steady

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to every Python worker of the application, once: tasks import it wherever they run."""
    steady(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "framelake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
