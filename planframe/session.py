"""Session helpers for scripts, tests and entry points."""

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package to the executors' Python, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    top = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="planframe-code-"), "planframe.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: a reliable checkpoint in the folder that the session names; a local session without one has its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="planframe-checkpoints-")
        context.setCheckpointDir(root)
    return df.checkpoint()


def local(cpus: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("planframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
