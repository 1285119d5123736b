"""Give the executors this package, so that their Python workers can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources with ``addPyFile``, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="tidewell-")) / f"{package.name}.zip"
        with zipfile.ZipFile(name, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(name))
        _shipped.add(context.applicationId)
    return spark
