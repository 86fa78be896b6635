"""Getting this package to Python workers on machines where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A temporary folder for the application; only for a session whose driver and executor are one process."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a machine's own folder is no place for a cluster's tables")
    return _SCRATCH.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='sparkloom-')}")


def shipped(spark: SparkSession) -> SparkSession:
    """Send the package's files along with the application's tasks; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom_workers.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(to))
        _SHIPPED.add(app)
    return spark
