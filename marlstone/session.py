"""Session construction and shared scratch storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    conf = {
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName("marlstone")
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset a local session takes a folder of its own; a cluster, whose machines
    would each write to their own disk, gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
            root = sc.getCheckpointDir()
    return root.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name under the shared scratch folder, deleted when the driver's JVM shuts down."""
    path = f"{scratch_root(spark)}/marlstone-{name}"
    hpath, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(hpath)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared scratch folder and read it back.

    Unlike an executor-local checkpoint the files outlive lost executors. They are removed by
    :func:`release`, or when the driver's JVM shuts down.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`materialise` that no later plan reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/marlstone-" in folder:
                hpath, fs = _hadoop_path(df.sparkSession, folder)
                fs.delete(hpath, True)
