"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 16 << 20


def get_spark(app: str = "graphloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local session without one gets a temporary one, a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if current is None:
            current = "file://" + tempfile.mkdtemp(prefix="graphloom-")
            spark.sparkContext.setCheckpointDir(current)
        return current.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh folder in the shared folder: its path, and its address for pyarrow's file systems in a worker."""
    path = shared_path(spark, name)
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)
    scheme, rest = fs.makeQualified(p).toUri().toString().split(":", 1)
    return path, f"{'s3' if scheme == 's3a' else scheme}:{rest if rest.startswith('//') else '//' + rest}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and read back from the shared folder.

    A written table rather than a held one: it survives the loss of any executor. A checkpoint keeps the size that was
    estimated for its plan, and a join's is the product of its sides: in a loop that joins its own results the number's
    digits double with every round until they fill the driver. A size that no table has is dropped.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() < 1 << 62:
        return out
    return type(out)(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), spark)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured size is under the limit, df itself otherwise.

    df should be cheap to read again (cut, or a file): measuring is one pass over it.
    The measure is the summed length of every column as text plus a fixed cost per row.
    """
    width = F.lit(48)
    for c, kind in df.dtypes:
        width = width + (F.coalesce(F.length(F.col(c)), F.lit(0)) if kind == "string" else F.lit(16))
    size = df.agg(F.sum(width.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= limit else df


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it does not exist."""
    fs, p = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_file_text(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def commit_file(spark: SparkSession, path: str, body: str) -> None:
    """Puts a file in place whole, or fails with FileExistsError if there is one: of two writers one wins.

    A hard link does it on a local file system, a rename without overwriting elsewhere.
    """
    jvm = spark._jvm
    fs, final = _file_system(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{final.getParent()}/.{final.getName()}-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(body.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(tmp.toUri().getPath(), final.toUri().getPath())
            fs.delete(tmp, False)
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(tmp, final, options)
    except (FileExistsError, Py4JJavaError) as e:
        fs.delete(tmp, False)
        raise FileExistsError(path) from e


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per context."""
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    out = Path(tempfile.mkdtemp(prefix="graphloom-zip-")) / "graphloom_pkg.zip"
    out.write_bytes(body.getvalue())
    sc.addPyFile(str(out))
    sc._graphloom_shipped = True
