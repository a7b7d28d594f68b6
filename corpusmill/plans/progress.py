"""Progress of Spark jobs as a text bar, and profiles of Python functions."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class ProgressBar:
    """``[=====>    ]  50% 5/10 3s``: as far as ``total`` is known."""

    total: int = 0
    completed: int = 0
    width: int = 40
    started: float = field(default_factory=time.time)

    @property
    def progress(self) -> float:
        return min(1.0, self.completed / self.total) if self.total else 0.0

    def add(self, n: int = 1) -> None:
        self.completed += n

    def finish(self) -> None:
        self.completed = self.total

    def __str__(self) -> str:
        full = int(self.progress * self.width)
        bar = "=" * full + (">" if full < self.width else "")
        return f"[{bar:<{self.width}}] {self.progress:4.0%} {self.completed}/{self.total} {time.time() - self.started:.0f}s"


def job_progress(spark: SparkSession) -> ProgressBar:
    """Tasks of the active stages."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    return ProgressBar(sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages))


def profile_functions(spark: SparkSession, kind: str = "perf") -> None:
    """Profile Python functions by time (``perf``) or memory; ``spark.profile.show()`` prints the result."""
    if kind not in ("perf", "memory"):
        raise ValueError("perf or memory")
    spark.conf.set("spark.sql.pyspark.udf.profiler", kind)
