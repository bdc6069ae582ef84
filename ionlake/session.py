"""Session defaults that the engine relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_session(app: str = "ionlake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return a session with adaptive execution, Arrow transfer and UTC.

    ``master`` and ``shuffle_partitions`` are for local use; on a cluster leave them unset so that
    the submitted configuration holds.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("IONLAKE_DRIVER_MEMORY", "8g")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, so that workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="ionlake-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(folder, "ionlake.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(at, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
