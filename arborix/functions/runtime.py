"""Worker threads of the local session (fixed once per process, as the pool they stand for), progress and cancelling of jobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CHOSEN: list[int] = []


def set_num_threads(n: int) -> None:
    """Ask for ``n`` threads before the session starts; asking for the same number again is fine."""
    if n < 1:
        raise ValueError("at least one thread is needed")
    if _CHOSEN and _CHOSEN[0] != n:
        raise RuntimeError(f"the number of threads is already {_CHOSEN[0]}")
    if not _CHOSEN:
        if SparkSession.getActiveSession() is not None and get_num_threads() != n:
            raise RuntimeError("the session has started")
        _CHOSEN.append(n)


def get_num_threads() -> int:
    """Cores the running session spreads work over; the wanted number before it starts."""
    spark = SparkSession.getActiveSession()
    return spark.sparkContext.defaultParallelism if spark is not None else (_CHOSEN or [1])[0]


def master() -> str:
    """The ``local[...]`` master for a session of the wanted width."""
    return f"local[{_CHOSEN[0]}]" if _CHOSEN else "local[*]"


@contextmanager
def jobs(spark: SparkSession, name: str) -> Iterator[None]:
    """All jobs started inside belong to ``name``; leaving by an error or Ctrl-C cancels those that still run."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    except BaseException:
        sc.cancelJobGroup(name)
        raise
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(key, None)


def cancel(spark: SparkSession, name: str) -> None:
    """Stop the running jobs of ``name``; whoever waits for them gets an error."""
    spark.sparkContext.cancelJobGroup(name)


def progress(spark: SparkSession, name: str) -> tuple[int, int]:
    """(done, all) tasks of the active stages of the running jobs of ``name``."""
    tracker, done, total = spark.sparkContext.statusTracker(), 0, 0
    for job in tracker.getJobIdsForGroup(name):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info and info.status == "RUNNING" else ():
            if s := tracker.getStageInfo(stage):
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done, total
