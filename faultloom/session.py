"""Session helpers: building a session, shared working folder, lineage cuts."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def get_session(app: str = "faultloom", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder. One of them must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; what is written there is removed when the process ends (or by :func:`release`)."""
    path = f"{shared_dir(spark)}/faultloom/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cuts the lineage by writing ``df`` as a table in the shared folder and reading it back.

    The copy survives the loss of an executor. Tables written
    here are removed when the process ends (or by :func:`release`). ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Removes everything written to the places that :func:`scratch` gave in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


atexit.register(release)
