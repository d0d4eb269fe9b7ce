"""Sessions, the folder that driver and executors share, and the engine's own code on executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).parent
_shipped: set[str] = set()
_roots: dict[str, str] = {}


def session(name: str = "loom", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the engine expects: UTC, adaptive execution."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place below spark.checkpoint.dir, or where that is unset (local sessions, as in tests) below a folder of our own; removed at the end."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = base or "file:///tmp/checkpoints"
        _roots[app] = f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return f"{_roots[app]}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read again, where its lineage ends."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, whatever their working directory: Spark serves it to executors as a zip."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = Path(tempfile.mkdtemp()) / "sparkloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
