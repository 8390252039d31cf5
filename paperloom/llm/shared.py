"""Tables that an operator writes and reads again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: The tables that this process has made, in order.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; in a local session without the setting, a temporary one."""
    where = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set(SETTING, where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_folder(spark)}/paperloom/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many tables have been made so far."""
    return len(_made)


def discard(spark: SparkSession, since: int, keep: int = 1, but: tuple[str, ...] = ()) -> None:
    """Deletes the tables made after the first `since`, but the last `keep` and those of the names `but`: for callers
    that read none of them any more."""
    last = len(_made) - keep
    spared = [place for place in _made[since:last] if place.rsplit("/", 1)[1].rsplit("-", 1)[0] in but]
    for place in _made[since:last]:
        if place not in spared:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made[since:last] = spared


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written as Parquet to the shared folder and read again: lineage ends there,
    so a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores after it if `docs` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_text(text: str, chars: int, pieces: int = 16) -> Column:
    """The text, or of one with more than `chars` code points that many, in pieces from all over it."""
    each = chars // pieces
    step = F.floor(F.length(text) / F.lit(pieces)).cast("int")
    parts = F.concat_ws(" ", *(F.substring(text, F.lit(1) + step * k, F.lit(each)) for k in range(pieces)))
    return F.when(F.length(text) > chars, parts).otherwise(F.col(text))
