"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of ``spark``, once for each application, unless their path holds it already."""
    app = spark.sparkContext.applicationId
    on_path = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _shipped or str(_ROOT.parent) in on_path:
        return
    target = Path(tempfile.mkdtemp(prefix="vecframe-ship-"), "vecframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
