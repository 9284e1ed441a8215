"""Intermediate results that survive the loss of an executor.

Iterative operators cut their lineage by writing Parquet into the folder the cluster shares
(``spark.checkpoint.dir``) and reading it back. Nothing is kept in executor memory, so a lost
executor costs a task retry only.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one the session already uses.

    Only a local master falls back to a temporary folder; a cluster without the setting uses its
    warehouse folder, which all executors reach.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if spark.sparkContext.master.startswith("local"):
        made = tempfile.mkdtemp(prefix="folioframe-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{made}")
        return f"file://{made}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_folioframe"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone; what is left lies in the checkpoint folder
        pass


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def publish(spark: SparkSession, made: str, path: str) -> None:
    """Give a folder that is complete its final name; if another process was first, its folder stays and this one goes."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of a path and of the size and time of the files directly in it, so that it changes when they do."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    seen = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    files = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in seen)
    return hashlib.md5("\n".join([path, *files]).encode()).hexdigest()


_SCOPES: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Intermediates of operators called inside are deleted at the end of the block, when their results must have been written.

    Without it they stay until the Python process ends, as a result that isn't written yet still reads them.
    """
    made: list[tuple[SparkSession, str]] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for spark, root in made:
            _delete(spark, root)


class Stash:
    """Written intermediates of one operator run; removed at the end of their ``scope``, else of the Python process."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(_delete, spark, self.root)
        if _SCOPES:
            _SCOPES[-1].append((spark, self.root))

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as a fresh scan."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._stash_path = path  # type: ignore[attr-defined]
        return back

    def put_counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The same, and the number of rows, which the write itself counts."""
        seen = Observation()
        back = self.put(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return back, int(seen.get.get("n") or 0)

    def drop(self, df: DataFrame) -> None:
        """Delete an intermediate that no later plan reads."""
        path = getattr(df, "_stash_path", None)
        if path:
            _delete(self.spark, path)
