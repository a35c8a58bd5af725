"""Ships this package to the executors, so that Python functions defined in it can run there wherever it is installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows are whole texts, so a batch of Spark's default of 10,000 rows may be hundreds of MB in a Python worker
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def deployed(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once for a context, and makes Arrow batches smaller where the session
    has not set them. The archive is the driver's, Spark sends it on."""
    context = spark.sparkContext
    if BATCH not in spark.conf.getAll:  # what is set, whatever it is, stays
        spark.conf.set(BATCH, BATCH_ROWS)
    if not getattr(context, "_lectio_deployed", False):
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="lectio-")) / "lectio_package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, Path(root.name) / f.relative_to(root))
        context.addPyFile(str(archive))
        context._lectio_deployed = True
    return spark


def ship() -> None:
    """For operators, before they make a Python function: what it needs of this package goes along with it."""
    deployed(SparkSession.active())
