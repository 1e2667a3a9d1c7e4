"""Making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once per application, unless workers find it by PYTHONPATH or their folder."""
    reachable = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    app = spark.sparkContext.applicationId
    if str(ROOT) not in reachable and app not in _SHIPPED:
        path = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted((ROOT / "quern").rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark
