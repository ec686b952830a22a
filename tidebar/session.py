"""Session helpers: settings, scratch folder and tables staged on shared storage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}
_staged: dict[tuple[str, str], str] = {}
_owners: list[list[str]] = []


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidebar")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # no call-site capture per expression: it doubles the time to build a large frame
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, seen by every executor.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is
    used only where that is unset, as in a local test.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            root = tempfile.mkdtemp(prefix="run-")
        _scratch[app] = f"{root.rstrip('/')}/tidebar-{app}"
    return _scratch[app]


def checkpoints(spark: SparkSession) -> None:
    """Sets the folder of reliable checkpoints where the cluster has not named one."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"{scratch_dir(spark)}/checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path in the scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


@contextlib.contextmanager
def owned(paths: list[str]):
    """Notes the tables that ``stage`` writes inside; their owner passes ``paths`` to ``discard`` when done with them."""
    _owners.append(paths)
    try:
        yield paths
    finally:
        _owners.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables and forgets them."""
    while paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table and read it back.

    Operators below read their input more than once (a row count per time
    range, then the rows). From a written table each read is a pruned scan and
    survives a lost executor; from a lazy aggregate it would be a new pass over
    the ticks.
    """
    path = new_path(df.sparkSession, name)
    for paths in _owners[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_once(spark: SparkSession, name: str, build) -> DataFrame:
    """Stage ``build()`` under ``name`` once per application, then reuse the table."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _staged or not exists(spark, _staged[key]):
        df = build()
        path = new_path(spark, "".join(c if c.isalnum() else "_" for c in name)[-60:])
        df.write.parquet(path)
        _staged[key] = path
    return spark.read.parquet(_staged[key])
