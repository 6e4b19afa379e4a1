"""Sessions, and getting this package's code to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: What the engine expects of any session: adaptive plans, and UTC so that timestamps mean the same everywhere.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | more
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors where their PYTHONPATH doesn't have it already."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_siltflow_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="siltflow-")) / "siltflow_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "siltflow").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._siltflow_shipped = True
