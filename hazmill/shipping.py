"""Make the package importable in Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once an application, unless PYTHONPATH already leads them to it."""
    app = spark.sparkContext.applicationId
    if _on_path or app in _sent:
        return
    _sent.add(app)
    folder = tempfile.mkdtemp(prefix="hazmill-")  # served by the driver for as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    where = Path(folder, "hazmill-package.zip")
    with zipfile.ZipFile(where, "w") as out:
        for path in sorted(ROOT.joinpath("hazmill").rglob("*")):
            if path.suffix in (".py", ".csv", ".json"):
                out.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(where))
