"""Making this package importable on the executors."""

from __future__ import annotations

import importlib.util
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows of an Arrow batch, where the application sets none: texts are long, and both sides of the pipe hold whole batches.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once an application; Spark's file server hands them out."""
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH_KEY) and spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    if sc.applicationId not in _shipped:
        root = Path(importlib.util.find_spec("gleanery").origin).parent
        at = Path(tempfile.mkdtemp()) / "gleanery_sources.zip"
        with zipfile.ZipFile(at, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(at))
        _shipped.add(sc.applicationId)
    return spark
