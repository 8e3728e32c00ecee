"""Session helpers: a tuned local session and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers that do not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if any(p and Path(p).resolve() == _ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    target = Path(tempfile.mkdtemp(prefix="lineweave-")) / "lineweave.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in (_ROOT / "lineweave").rglob("*.py"):
            out.write(path, path.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(target))
