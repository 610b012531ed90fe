"""Session factory and the shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "quire", **conf: str) -> SparkSession:
    """UTC, AQE on, few shuffle partitions; a cluster sets its own master and sizes."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: sent once per session unless they find it anyway."""
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if getattr(spark, "_quire_shipped", False) or any(p and Path(p).resolve() == ROOT for p in paths):
        return
    packed = Path(tempfile.mkdtemp(prefix="quire-ship-")) / "quire.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted((ROOT / "quire").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(packed))
    spark._quire_shipped = True
