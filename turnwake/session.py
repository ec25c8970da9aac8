"""Session settings the plans rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

#: Clock arithmetic is done in UTC; joins and shuffles are re-planned at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "turnwake", memory: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``memory`` and ``cores`` cap each executor, and the driver on a local master."""
    caps = {"spark.executor.memory": memory, "spark.driver.memory": memory, "spark.executor.cores": cores, "spark.cores.max": cores}
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k: str(v) for k, v in caps.items() if v is not None} | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """A session given by others with the clock in UTC, which stays so: the plans it returns run later."""
    spark.conf.set("spark.sql.session.timeZone", SETTINGS["spark.sql.session.timeZone"])
    return spark


def only_row(df: DataFrame) -> Row:
    """The row of a result that must have one and no more."""
    got = df.take(2)
    if len(got) != 1:
        raise ValueError(f"one row was expected, there are {'none' if not got else 'several'}")
    return got[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which executors share; one is made only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="turnwake-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs no more than its tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
