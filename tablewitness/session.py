"""Session helpers and the written tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import wraps
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_MADE: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("made", default=())
R = TypeVar("R")


def local_session(cores: str = "8", app: str = "tablewitness") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder, because executors on other machines could not read that.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tablewitness-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back.

    Used where a later step must see exactly the same rows in the same partitions twice: a
    recomputed range partitioning may pick other bounds, a written table cannot change.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    for made in _MADE.get():
        made.append(out)
    return out


@contextmanager
def steps_made() -> Iterator[list[DataFrame]]:
    """The list of all tables that ``stage`` writes in the block, also in threads that ``together`` starts there."""
    made: list[DataFrame] = []
    token = _MADE.set((*_MADE.get(), made))
    try:
        yield made
    finally:
        _MADE.reset(token)


def checkpoints(spark: SparkSession) -> None:
    """Give the session a shared folder for checkpoints unless it has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "checkpoints"))


def discard(tables: Sequence[DataFrame], keep: Sequence[DataFrame] = ()) -> None:
    """Remove the files of staged tables that nothing will read again, all but those to ``keep``."""
    kept = {id(df) for df in keep}
    for df in tables:
        if id(df) in kept:
            continue
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, written; the steps that it wrote on the way are removed."""
    with steps_made() as made:
        out = stage(make(), label)
    discard(made, [out])
    return out


def frees_shuffles(func: Callable[..., R]) -> Callable[..., R]:
    """``func(df, ...)`` whose jobs remove their shuffle files as they end, not when the driver happens to collect garbage.

    What later steps read is written by ``stage``. The session's own setting comes back afterwards.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @wraps(func)
    def run(df: DataFrame, *args, **kwargs) -> R:
        conf = df.sparkSession.conf
        before = conf.get(key, "false")
        conf.set(key, "true")
        try:
            return func(df, *args, **kwargs)
        finally:
            conf.set(key, before)

    return run


def together(tasks: Sequence[Callable[[], R]], jobs: int = 8) -> list[R]:
    """Run independent Spark jobs at the same time and return their results in order.

    Small jobs fill the gaps of large ones, and each keeps a plan of its own instead of being one
    branch of a huge plan that is re-optimised whenever any stage ends. The threads keep the caller's job
    group, description and pool; when one task fails, those that have not begun are dropped.
    """
    pool = ThreadPoolExecutor(jobs)
    try:
        return [f.result() for f in [pool.submit(copy_context().run, inheritable_thread_target(task)) for task in tasks]]
    finally:
        pool.shutdown(cancel_futures=True)
