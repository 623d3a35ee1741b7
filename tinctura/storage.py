"""Tables in and intermediate tables out.

Intermediate results that several stages read are written as Parquet to the shared folder named by
``spark.checkpoint.dir``: that cuts the lineage, survives the loss of any executor and keeps column pruning, which
an RDD checkpoint doesn't. Only where the setting is absent (tests, a laptop) a temporary folder is used, and only
for a local master.
"""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

#: Places to remove, by the scope they were written in.
_written: list[tuple[SparkSession, str]] = []
#: Bytes in memory a value takes beside its letters, for estimates of what a table takes when it is broadcast.
_PER_VALUE = 16
_shipped: set[str] = set()
#: Scans with less than this for each core are dealt out before costly stages.
SPREAD_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to Python workers that may not be able to import it, once per application.

    On a cluster always; on a local master only if the workers don't get its folder by PYTHONPATH.
    """
    home, sc = Path(__file__).resolve().parent, spark.sparkContext
    local = sc.master.startswith("local[") and str(home.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if local or sc.applicationId in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in home.rglob("*.py"):
            z.write(p, p.relative_to(home.parent))
    path = f"{shared_dir(spark)}/tinctura-{uuid.uuid4().hex}.zip"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path)
    _written.insert(0, (spark, path))  # outside of any scope
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``; for a scan the size of its columns in the files. Runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, *, bytes_a_core: int = SPREAD_BYTES) -> DataFrame:
    """A scan of less than ``bytes_a_core`` for each core, dealt out to all; larger scans have splits enough and stay.

    For stages that compute much per row: a small file may come as few splits, or as one row group. The shuffle is
    bounded by those bytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * bytes_a_core else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, taken from ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="tinctura-")
    spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed with its scope or when the driver ends."""
    path = f"{shared_dir(spark)}/tinctura-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``materialize``, with the bytes its rows take in memory, counted as they are written: no job of its own."""
    seen = Observation()
    kinds = dict(df.dtypes)
    text = lambda c: F.col(f"`{c}`") if kinds[c] == "string" else F.to_json(F.struct(f"`{c}`"))
    numbers = lambda k: re.fullmatch(r"array<(double|float|bigint|int|smallint|tinyint)>", k)
    length = lambda c: F.size(f"`{c}`") * 8 if numbers(kinds[c]) else F.octet_length(text(c))
    long = [F.greatest(F.coalesce(length(c), F.lit(0)), F.lit(0)) for c in df.columns if kinds[c] == "string" or "<" in kinds[c]]
    size = F.sum(sum(long, F.lit(_PER_VALUE * (len(df.columns) + 1))).cast("long"))
    out = materialize(df.observe(seen, size.alias("bytes")), name)
    return out, seen.get["bytes"] or 0


@contextmanager
def scope() -> Iterator[None]:
    """Removes what is written inside it when it ends; for sessions that run many queries, one scope each."""
    began = len(_written)
    try:
        yield
    finally:
        _remove(began)


def _remove(since: int = 0) -> None:
    for spark, path in _written[since:]:
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
    del _written[since:]


atexit.register(_remove)
