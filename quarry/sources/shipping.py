"""Makes this package importable in Python workers, on one machine or a cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors of ``spark``, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quarry-src-")) / "quarry_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(str(target))
    sc._quarry_shipped = True
