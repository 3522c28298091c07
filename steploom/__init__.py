"""Continuous-query analytics on PySpark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Make this package importable in Python workers, once a Spark application.

    Nothing is sent where ``PYTHONPATH`` already holds the package's folder, as on a cluster that
    has it installed.
    """
    root, app = Path(__file__).resolve().parent, spark.sparkContext.applicationId
    if app in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    to = Path(tempfile.mkdtemp(prefix="steploom-")) / "steploom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
