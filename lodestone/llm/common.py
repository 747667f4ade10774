"""Helpers that the operators of this subpackage share: table access, staged tables, word classes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of the word class ``[^\x20\x09-\x0D]+``.
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, only a session whose executors are threads of the driver gets a temporary folder of this
    machine instead; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    own = tempfile.mkdtemp(prefix="stages-")
    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: its lineage ends there.

    The shuffle files behind it go when it is written, and its own files when `dropped` or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FILES_GO, None)
    spark.conf.set(_FILES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FILES_GO) if before is None else spark.conf.set(_FILES_GO, before)
    gone_with_session(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def gone_with_session(spark: SparkSession, path: str) -> None:
    """Files at a path, which is there, go when the driver's JVM ends."""
    _at(spark, path, lambda files, at: files.deleteOnExit(at))


def _at(spark: SparkSession, path: str, do) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    do(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)


def dropped(*tables: DataFrame | None) -> None:
    """Delete staged tables; nothing that is yet to run may read them. Others are left alone."""
    for t in tables:
        path = None if t is None else t.__dict__.get("staged_at")
        if path:
            _at(t.sparkSession, path, lambda files, at: files.delete(at, True))


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null: empty) and the columns named; all others, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *[F.col(c) for c in extra])


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite components; an empty one does not."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


#: Integers made of components stay within this bound, so that exact sums of squares fit 38 digits.
WIDEST = float(2**55)


def floored(vector: Column, scale: float, offset: int = 0) -> Column:
    """floor(scale * component) + offset of every component, as longs; beyond 2^55 either way the bound is taken."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(WIDEST)), F.lit(-WIDEST))).cast("long") + F.lit(offset).cast("long"))


def looked_up(big: DataFrame, small: DataFrame, keys: tuple[str, ...], weight: str, n: int, share: int = 1000) -> DataFrame:
    """``big`` with the columns of ``small`` beside ``keys`` and ``weight``, which has each key once; null keys meet.

    ``weight`` is a key's number of rows in ``big``. Keys of over 1 / ``share`` of the ``n`` rows are so few that they
    are broadcast; the rest is shuffled, and no key of it is hot. Rows of ``big`` without a match go.
    """
    kept = [c for c in small.columns if c not in (*keys, weight)]

    def meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        left, right = left.alias("l"), right.alias("r")
        out = left.join(right, reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]), how)
        return out.select("l.*", *[f"r.{c}" for c in kept]) if how == "inner" else out

    hot = small.filter(F.col(weight) * share > n)
    cold = meet(big, F.broadcast(hot.select(*keys)), "left_anti")
    return meet(big, F.broadcast(hot), "inner").unionByName(meet(cold, small.filter(F.col(weight) * share <= n), "inner"))
