"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    # JSON objects with a repeated key keep the last value, as Python's parser does.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The JVM never compiles larger methods; long check expressions run faster split up.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


# Bytes of rows that Spark hands to Python at a time. A task holds such a batch in the JVM, on its way
# and in Python; Spark's default of 64 MB only ends at 10,000 rows where they are short.
BATCH_OPTION, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the operators rely on."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batches for Python to ``BATCH_BYTES``, unless the user has set their size."""
    if int(spark.conf.get(BATCH_OPTION).rstrip("bB")) == 64 << 20:
        spark.conf.set(BATCH_OPTION, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else the session's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def free_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table that ``scratch_path`` named, once nothing reads it any more."""
    if not path.startswith(f"{shared_dir(spark)}/gristmill/"):
        raise ValueError(f"not a scratch table: {path}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/gristmill/{label}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this library, wherever the driver has it from; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    # Spark serves the archive to the executors itself.
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
