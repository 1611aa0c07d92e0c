"""Send this package to the executors, so that Python functions work where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Once for each application, before a DataFrame with a Python function is made."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # else it runs from an archive that was sent already
        archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, Path("tidemark") / file.relative_to(package))
        context.addPyFile(str(archive))
    _done.add(context.applicationId)
