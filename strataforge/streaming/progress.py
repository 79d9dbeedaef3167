"""Progress of plans and streams: rows and errors of each stage, and tasks done while a plan runs."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Progress:
    """Counts of the named stages of a plan, gathered as the rows pass, without a second run.

    ``say`` is called with (stage, rows, errors) as soon as the action that a stage belongs to
    has ended. A stage whose plan is run twice keeps the counts of the first run.
    """

    say: Callable[[str, int, int], None] | None = None
    stages: dict[str, Observation] = field(default_factory=dict)

    def stage(self, df: DataFrame, name: str, error: Column | None = None) -> DataFrame:
        """``df`` with its rows and those where ``error`` holds counted as a stage of this name."""
        if name in self.stages:
            raise ValueError(f"two stages named {name}")
        seen = self.stages[name] = Observation()
        out = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(error if error is not None else F.lit(False)).alias("n_errors"))
        if self.say:
            threading.Thread(target=lambda: self.say(name, *self._of(seen)), daemon=True).start()
        return out

    @staticmethod
    def _of(seen: Observation) -> tuple[int, int]:
        found = seen.get
        return found["n_rows"], found["n_errors"]

    def counts(self, spark: SparkSession) -> DataFrame:
        """(stage, n_rows, n_errors) in the order of the stages; waits until each has run."""
        return spark.createDataFrame([(name, *self._of(seen)) for name, seen in self.stages.items()], "stage string, n_rows long, n_errors long")


def tasks(spark: SparkSession, group: str) -> list[tuple[str, int, int, int]]:
    """(stage, tasks, done, failed) of the stages of a job group that are known now; call it while an action runs."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    infos = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
    return sorted((i.name, i.numTasks, i.numCompletedTasks, i.numFailedTasks) for i in infos if i)


class StreamProgress(StreamingQueryListener):
    """(trigger, rows read, observed counts) of each trigger, and errors of streams that end with one."""

    def __init__(self, say: Callable[[int, int, dict], None] | None = None) -> None:
        self.say, self.triggers, self.errors = say, [], []

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        row = (p.batchId, p.numInputRows, {name: r.asDict() for name, r in p.observedMetrics.items()})
        self.triggers.append(row)
        if self.say:
            self.say(*row)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if event.exception:
            self.errors.append(event.exception)
