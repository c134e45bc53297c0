"""Session settings and the two helpers that touch the cluster's shared folders."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to Python, or come from there, at a time; a longer row goes alone.
BATCH_BYTES = 1 << 20


def build_session(app: str = "gradeloom", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back
    to a temporary folder: executors on other machines could not read one.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can read")
        folder = tempfile.mkdtemp(prefix="gradeloom-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of about ``BATCH_BYTES``.

    Spark's own limits are rows and 64 MB; a batch of texts then takes that much several
    times over, in the executor outside its heap and in each worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
