"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Settings the operators rely on; everything else is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the few session settings whose absence would change results."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per session, so that they need not find it on their own path."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if not getattr(sc, "_pagewright_shipped", False) and (root / "pagewright").is_dir():
        archive = Path(tempfile.mkdtemp(prefix="pagewright-")) / "pagewright.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((root / "pagewright").rglob("*.py")):
                out.write(file, file.relative_to(root))
        sc.addPyFile(str(archive))
        sc._pagewright_shipped = True
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return ship(configure(session))


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; one is made only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pagewright-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder. A checkpoint keeps the size that its plan was estimated at, which
    a join multiplies; what is read back from files has their size, so rounds of joins are planned by what is there. With
    ``by``, every value of that column has a folder of its own."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Narrow rows that a partition may hold before there is reason for another one.
ROWS_PER_PART = 50_000


def gathered(df: DataFrame, n: int) -> DataFrame:
    """``df``, of at most about ``n`` narrow rows, in no more partitions than they need. A task costs the same files and log
    lines whether it has rows or not, and a checkpoint keeps its partitions for all that read it."""
    return df.coalesce(max(1, -(-n // ROWS_PER_PART)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keep the Arrow batches that carry whole texts to Python small, for this session from now on.

    A batch is held by the JVM and by the Python worker at once; the default of 10,000 rows is too many where a text can
    be hundreds of kilobytes long.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def sized_batches(spark: SparkSession, size: str = "4m", rows: int = 20_000) -> None:
    """Bound Arrow batches by bytes, for this session from now on: few whole texts, or many narrow rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def nullable(schema: T.StructType) -> T.StructType:
    """``schema`` with every column nullable: what a Python function may return."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
