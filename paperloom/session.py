"""Session defaults, paths, models by name, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINTS = "spark.checkpoint.dir"


def session(name: str = "paperloom", **settings: str) -> SparkSession:
    """A session with the settings that the plans count on; `settings` come on top, with _ for dots."""
    wanted = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("_", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=wanted).getOrCreate()


T = TypeVar("T")


def safely(make: Callable[[], T], fallback: T) -> T:
    """What `make` returns, or the fallback if it raises; in columns, the try_ functions do that."""
    try:
        return make()
    except Exception:  # noqa: BLE001
        return fallback


@dataclass(frozen=True)
class Config:
    """Where a service's files are, and the numbers that its steps take."""

    name: str
    root: str = "."
    service: str = "Categories"
    top_k: int = 20
    rerank_k: int = 10
    max_depth: int = 4
    max_chars: int = 2000

    def path(self, kind: str, suffix: str = "") -> str:
        return f"{self.root}/{self.service}/{self.name}_{kind}{suffix}"

    @property
    def bundle(self) -> str:
        return self.path("Index")


class Models:
    """Models by name, each loaded once by the loader that is registered for it; a name without one raises."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable[[], object]] = {}
        self._loaded: dict[str, object] = {}

    def register(self, name: str, loader: Callable[[], object]) -> None:
        self._loaders[name] = loader
        self._loaded.pop(name, None)

    def get(self, name: str) -> object:
        if name not in self._loaded:
            if name not in self._loaders:
                raise KeyError(f"no loader for {name}")
            self._loaded[name] = self._loaders[name]()
        return self._loaded[name]


#: The tables that cut_lineage has written, in order.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for what jobs share. A local session without one gets a temporary folder."""
    where = spark.conf.get(CHECKPOINTS, None) or spark.sparkContext.getConf().get(CHECKPOINTS)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINTS} to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set(CHECKPOINTS, where)
    return where.rstrip("/")


def cut_lineage(rows: DataFrame) -> DataFrame:
    """`rows` written as Parquet to the shared folder and read again, so that loops neither recompute nor lose what
    an executor had, and later steps read only the columns that they need."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/paperloom/cut-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    _written.append(path)
    return spark.read.schema(rows.schema).parquet(path)


def cuts() -> int:
    """How many tables cut_lineage has written and nobody has dropped."""
    return len(_written)


def drop_cuts(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Deletes the tables that cut_lineage wrote after the first `since`, but the last `keep`: for callers that read them no more."""
    last = len(_written) - keep
    for place in _written[since:last]:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if last > since:
        del _written[since:last]
