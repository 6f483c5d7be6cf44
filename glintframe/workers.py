"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ensure_workers(spark: SparkSession) -> None:
    """Ship the package to the executors unless their PYTHONPATH already has it.

    A cluster normally gets the package by ``--py-files`` or its image; this covers a driver that only
    changed ``sys.path``. The archive is built on the driver and served by Spark itself.
    """
    sc = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(_ROOT) in on_path or sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="glintframe-")) / "glintframe_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((_ROOT / "glintframe").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
