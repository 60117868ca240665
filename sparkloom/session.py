"""Sessions with the settings that the library's results rest on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI rules and adaptive execution; ``conf`` keys have ``_`` for ``.``."""
    b = SparkSession.builder.appName("sparkloom")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=settings | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors share, as ``spark.checkpoint.dir`` names it; on a local master a temporary one if it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A folder to be written, in the shared one; it goes when the session ends."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{uuid.uuid4().hex}")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(root)
    files.deleteOnExit(root)
    return f"{root.toString()}/files"


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read again, so that what is random or sampled in it is settled once."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
