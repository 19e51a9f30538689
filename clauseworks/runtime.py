"""Session helpers: a tuned session, the shared folder, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "clauseworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='clauseworks-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: Rows and bytes of an Arrow batch. Texts are long, and a batch must fit in a Python worker.
ROWS_PER_BATCH, BYTES_PER_BATCH = 2000, 16 << 20


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH, size: int = BYTES_PER_BATCH) -> None:
    """Bound the memory of a Python worker: few rows and bytes per Arrow batch (or one row that is larger)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


_written: list[str] = []


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage like checkpoint() but computes df once, and survives lost executors. The
    files stay until release(), since lazy results may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file:").lstrip("/")
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written() -> set[str]:
    """The tables of materialize() that this process has written so far."""
    return set(_written)


def release(spark: SparkSession, but: set[str] = frozenset(), keep: DataFrame | None = None) -> None:
    """Delete the tables that materialize() wrote in this process, except those in `but` and those that keep reads.

    Results that read the others must be saved by then.
    """
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for place in [p for p in _written if p not in but and p.rpartition("/")[2] not in read]:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(place)
