"""Shared scratch tables: the only way these operators cut lineage.

Tables go to the folder named by ``spark.checkpoint.dir``, which driver and executors share, so a lost
executor costs a re-read and no data. Only where the session names none (tests) is a local folder made.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, as a URI or path."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


class Folder:
    """Tables in one folder of any file system that Spark reaches; they stay when the session ends."""

    lasting = True

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def _delete(self, path: str) -> None:
        fs, path = self._at(path)
        fs.delete(path, True)

    def exists(self, name: str) -> bool:
        fs, path = self._at(f"{self.path}/{name}")
        return fs.exists(path)

    def names(self, name: str) -> list[str]:
        """What a folder below this one holds; nothing if there is none."""
        fs, path = self._at(f"{self.path}/{name}")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str, kind: str = "parquet") -> DataFrame:
        out = self.spark.read.format(kind).load(f"{self.path}/{name}")
        out.kept_as = name
        return out

    def keep(self, df: DataFrame, name: str = "t", codec: str | None = None) -> DataFrame:
        """Write df as Parquet, with the session's codec or another, and return the table read back."""
        name = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}", compression=codec)
        out = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
        out.kept_as = name
        return out

    def remove(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by keep() that nothing reads any more."""
        for table in tables:
            self.remove(table.kept_as)

    def release(self) -> None:
        """Let Spark delete the shuffle files of steps that are over; it does so when their plans are garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


class Scratch(Folder):
    """A fresh folder for one run of an operator. What the result reads of it stays until the driver's process ends."""

    lasting = False

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
        atexit.register(self._discard)

    def _discard(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            self._delete(self.path)


def sift(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = 1 << 25) -> DataFrame:
    """The rows whose key may be among wanted_key: all that are, and few others while the bitmap is sparse.

    To be used before a shuffled join of wide rows. The broadcast bitmap has `bits` bits whatever the input; when
    everything is wanted it lets everything pass. Null keys do not pass.
    """
    page = 1 << 15
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits).cast("long"))
    marks = wanted.filter(wanted_key.isNotNull()).select(place(wanted_key).alias("_p"))
    pages = marks.groupBy((F.col("_p") / page).cast("long").alias("_page")).agg(F.bitmap_construct_agg(F.col("_p") % page).alias("_bits"))
    at = F.col("_p") % page
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.filter(key.isNotNull()).withColumn("_p", place(key)).withColumn("_page", (F.col("_p") / page).cast("long"))
    hit = F.getbit(byte, (at % 8).cast("int")) == 1
    return marked.join(F.broadcast(pages), "_page").filter(hit).drop("_p", "_page", "_bits")
