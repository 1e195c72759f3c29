"""What a piece of work costs, out of the figures that Spark keeps of stages; one row for each round of a loop."""

from __future__ import annotations

import contextlib
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COST = "wall_ms long, cpu_ms long, task_ms long, rows_read long, rows_shuffled long, bytes_shuffled long, bytes_spilled long"
ROUND = f"round long, asked long, derived long, found long, handled long, {COST}"


@contextlib.contextmanager
def measured(spark: SparkSession):
    """Yields a dict that holds the columns of COST when the block is left: of all jobs that this thread began in it.

    task_ms is the time of all tasks, cpu_ms what they spent computing. Spark forgets
    stages beyond spark.ui.retainedStages: longer work is to be measured in parts.
    """
    context, tag, out, begun = spark.sparkContext, f"measured-{uuid.uuid4().hex}", {}, time.monotonic()
    context.addJobTag(tag)
    try:
        yield out
    finally:
        context.removeJobTag(tag)
        wall = int(1000 * (time.monotonic() - begun))
        tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
        jobs = list(context._jsc.sc().statusTracker().getJobIdsForTag(tag))
        late = time.monotonic() + 5  # figures come a moment after the results
        while any((info := tracker.getJobInfo(j)) and info.status == "RUNNING" for j in jobs) and time.monotonic() < late:
            time.sleep(0.01)
        ids = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        stages = [store.lastStageAttempt(s) for s in ids if tracker.getStageInfo(s)]
        add = lambda name: sum(getattr(s, name)() for s in stages)
        spilled = add("diskBytesSpilled")
        out.update(wall_ms=wall, cpu_ms=add("executorCpuTime") // 10**6, task_ms=add("executorRunTime"), rows_read=add("inputRecords"), rows_shuffled=add("shuffleWriteRecords"), bytes_shuffled=add("shuffleWriteBytes"), bytes_spilled=spilled)


def _rows(observed: Observation) -> int:
    """Spark drops a part of a plan that turns out to be empty while it runs, and its observation with it: there is no row of figures then."""
    try:
        return observed.get["rows"]
    except Py4JJavaError:
        return 0


class Rounds:
    """The figures of a loop: what each round asked, derived (repeats included), found anew and handled, and its cost."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.open = spark, [], []

    @contextlib.contextmanager
    def one(self):
        """A round; yields a dict for asked, found and handled. A round that fails leaves no row."""
        counts: dict[str, int] = {}
        self.open = []
        with measured(self.spark) as cost:
            yield counts
            derived = sum(map(_rows, self.open))
        self.rows.append({"round": len(self.rows) + 1, "asked": counts.get("asked", 0), "derived": derived, "found": counts.get("found", 0), "handled": counts.get("handled", 0), **cost})

    def counted(self, df: DataFrame) -> DataFrame:
        """df, whose rows count as derived in this round; it must be computed in it."""
        self.open.append(Observation())
        return df.observe(self.open[-1], F.count(F.lit(1)).alias("rows"))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r[c.split()[0]] for c in ROUND.split(", ")) for r in self.rows], ROUND)


def one(rounds: Rounds | None):
    """A round of rounds, or nothing where none are asked for."""
    return contextlib.nullcontext({}) if rounds is None else rounds.one()


def counted(rounds: Rounds | None, df: DataFrame) -> DataFrame:
    return df if rounds is None else rounds.counted(df)
