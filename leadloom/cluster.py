"""What every multi-stage operator needs from the cluster: imports on the workers, tables between stages in the shared folder,
and broadcasts behind a size check."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextvars import ContextVar
from functools import lru_cache, wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)

#: Rows (of a few short columns) up to which a table is broadcast, and its bytes as written; beyond either the join shuffles.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20

#: The tables that the running operator wrote; None outside of operators.
_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


@lru_cache(maxsize=8)
def _folder(application: str, named: str | None, master: str) -> str:
    if named:
        return f"{named.rstrip('/')}/leadloom-{application}"
    if not master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='leadloom-')}"


def shared_folder(spark: SparkSession) -> str:
    """Where tables between stages go: in ``spark.checkpoint.dir``; on one machine without that setting, a temporary folder."""
    context = spark.sparkContext
    return _folder(context.applicationId, spark.conf.get("spark.checkpoint.dir", None) or None, context.master)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table, if the session is still there."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  a folder that stays is no failure of the query
        pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read from there: later stages start from it (so do retries after a lost executor), with its
    true size. Inside an operator (``scoped``) it is deleted when the operator has returned, else when the session ends."""
    spark = prepare(df.sparkSession)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._at = path
    mine = _written.get()
    if mine is None:
        atexit.register(drop, spark, path)
    else:
        mine.append(out)
    return out


def scoped(f):
    """An operator that cleans up: the tables that it cut are deleted when it returns; the frames it returns (one, or a tuple of them) are cut
    too, and belong to the operator around it, or to the session."""

    @wraps(f)
    def run(*args, **kwargs):
        mine: list[DataFrame] = []
        token = _written.set(mine)
        stays: list[DataFrame] = []
        try:
            out = f(*args, **kwargs)
            parts = out if isinstance(out, tuple) else (out,)
            parts = tuple(p if not isinstance(p, DataFrame) or any(p is m for m in mine) else cut(p) for p in parts)
            stays = [m for m in mine if any(m is p for p in parts)]
        finally:
            _written.reset(token)
            for m in mine:
                if not any(m is s for s in stays):
                    drop(m.sparkSession, m._at)
        around = _written.get()
        for s in stays:
            if around is None:
                atexit.register(drop, s.sparkSession, s._at)
            else:
                around.append(s)
        return parts if isinstance(out, tuple) else parts[0]

    return run


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already cut, so that its size is known), hinted for broadcast only when it has at most ``rows`` rows and BROADCAST_BYTES as written."""
    return F.broadcast(df) if is_small(df, rows) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` with the other columns of ``table`` (already cut, one row a key) by ``key``, null where it has none.

    A small table is broadcast. Beside a larger one the rows without a key stay where they are: in a join they would all meet in one task.
    """
    if is_small(table):
        return df.join(F.broadcast(table), key, "left")
    more = [c for c in table.columns if c != key]
    without = df.where(F.col(key).isNull()).select(*df.columns, *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in more])
    return df.where(F.col(key).isNotNull()).join(table, key, "left").unionByName(without)
