"""Making the package importable by Python workers that don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per context: where a worker can't import the package, Spark distributes it as a zip file from the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    # a function of no module is pickled with its code, so that the probe itself needs nothing
    probe = eval("lambda _: __import__('importlib.util').util.find_spec('quern') is not None", {"__name__": "__main__"})
    if not sc.parallelize([0], 1).map(probe).first():
        root = Path(__file__).resolve().parent.parent
        path = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
    sc._quern_shipped = True
