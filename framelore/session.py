"""Spark sessions and shipping the package to the workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: The state store that streaming operators with state of their own need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_shipped: set[str] = set()


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the library expects: adaptive execution, UTC, RocksDB state."""
    builder = SparkSession.builder.master(master).appName("framelore")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        PROVIDER[0]: PROVIDER[1],
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the Python workers, once for each application: they may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, buffer = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="framelore-")  # Spark's file server hands it out as long as the application runs
    target = Path(folder) / "framelore.zip"
    target.write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
