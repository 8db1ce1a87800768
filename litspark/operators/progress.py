"""Long writes that tell how far they are, can be cancelled, and leave whole output or none.

A run's jobs have a tag, by which they are cancelled together, and a group, by which the status tracker counts their tasks;
the rows that pass are counted by an Observation in the same job.  Output is written beside its place and moved there
when it is whole.  A run in steps keeps the steps that are done, so a cancelled one goes on where it stopped.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import path_exists

STATES = ("running", "completed", "cancelled", "failed")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a whole folder; the target's parent is made, and an existing target is an error."""
    fs, a = _fs(spark, source)
    _, b = _fs(spark, target)
    if fs.exists(b):
        raise FileExistsError(target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be moved to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Run:
    """One action over a frame in a thread of its own: start(), progress(), cancel(), wait()."""

    def __init__(self, df: DataFrame, action: Callable[[DataFrame], None], kept: Column | None = None):
        self.spark, self.tag, self.state, self.error = df.sparkSession, f"run-{uuid.uuid4().hex}", "running", None
        self._seen, self._action, self._cancelled = Observation(), action, threading.Event()
        one = F.count(F.lit(1)).alias("rows")
        self._df = df.observe(self._seen, one, F.count_if(F.coalesce(kept, F.lit(False)) if kept is not None else F.lit(True)).alias("kept"))
        self._thread = threading.Thread(target=self._run, daemon=True)
        self.seconds = 0.0

    def _run(self) -> None:
        sc, began = self.spark.sparkContext, time.perf_counter()
        sc.setJobGroup(self.tag, "tracked run", interruptOnCancel=True)
        sc.addJobTag(self.tag)
        try:
            if self._cancelled.is_set():
                raise InterruptedError
            self._action(self._df)
            self.state = "completed"
        except BaseException as e:  # also what py4j raises for an interrupted job
            self.state, self.error = ("cancelled", None) if self._cancelled.is_set() else ("failed", e)
        finally:
            sc.removeJobTag(self.tag)
            self.seconds = time.perf_counter() - began

    def start(self) -> Run:
        self._thread.start()
        return self

    def progress(self) -> dict:
        """state, tasks done and known so far, and the share; later stages add tasks when they are planned."""
        tracker = self.spark.sparkContext.statusTracker()
        done = known = 0
        for job in tracker.getJobIdsForGroup(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                if s:
                    done, known = done + s.numCompletedTasks, known + s.numTasks
        share = 1.0 if self.state == "completed" else done / known if known else 0.0
        return {"state": self.state, "tasks_done": done, "tasks": known, "share": share}

    def cancel(self) -> None:
        """Interrupt the run's jobs; those of others go on."""
        self._cancelled.set()
        while self._thread.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)  # again, as a job may be submitted after the first call
            self._thread.join(0.2)

    def wait(self, timeout: float | None = None) -> dict:
        """The run's figures when it has ended: state, rows, kept, discarded, seconds, rows_per_second.  A failure is raised;
        of a run that was cancelled no rows are known."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(self.tag)
        if self.error is not None:
            raise self.error
        seen = self._seen.get if self.state == "completed" else {"rows": None, "kept": None}
        rows, kept = seen["rows"], seen["kept"]
        return {
            "state": self.state, "rows": rows, "kept": kept, "discarded": None if rows is None else rows - kept, "seconds": round(self.seconds, 3),
            "rows_per_second": None if rows is None else round(rows / max(self.seconds, 1e-9), 1),
        }


def start_write(df: DataFrame, path: str, kept: Column | None = None) -> Run:
    """Start writing df to a path that doesn't exist yet.  Cancelled or failed, nothing is left there or beside it."""
    spark = df.sparkSession
    if path_exists(spark, path):
        raise FileExistsError(path)

    def write(rows: DataFrame) -> None:
        beside = f"{path}.part-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(beside)
            move(spark, beside, path)
        finally:
            remove(spark, beside)

    return Run(df, write, kept).start()


def measure(df: DataFrame, kept: Column | None = None) -> dict:
    """Rows, seconds and rows a second of computing df, into no sink."""
    return Run(df, lambda rows: rows.write.format("noop").mode("overwrite").save(), kept).start().wait()


def write_in_steps(
    df: DataFrame, key: str, path: str, steps: int = 10, on_step: Callable[[int, int, dict], bool | None] | None = None, kept: Column | None = None
) -> DataFrame | None:
    """Write df by hashes of key to path/step=i; steps that are there are not done again.  on_step(step, steps, figures) is
    told of every step and ends the run by returning False.  Returns the table, or None if the run ended early."""
    spark = df.sparkSession
    for i in range(steps):
        at = f"{path}/step={i}"
        if path_exists(spark, at):
            continue
        figures = start_write(df.filter(F.pmod(F.xxhash64(key), F.lit(steps)) == i), at, kept).wait()
        if on_step is not None and on_step(i, steps, figures) is False and i + 1 < steps:
            return None
    return spark.read.parquet(path).drop("step")
