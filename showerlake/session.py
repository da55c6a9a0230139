"""Session defaults, and sending this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", **more: str) -> SparkSession:
    """A session with the defaults above; `more` uses underscores for dots."""
    conf = DEFAULTS | {k.replace("_", "."): str(v) for k, v in more.items()}
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context: workers need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_showerlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="showerlake-zip-")) / "showerlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._showerlake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one is made only where none is set and this machine is the whole cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="showerlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def keeper(spark: SparkSession):
    """A function that stores a table in the shared checkpoint folder and cuts its lineage.

    Level-by-level walks call it once per level: each level is then computed once, and a lost executor
    costs one level at most.
    """
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return lambda df: df.checkpoint(eager=True)
