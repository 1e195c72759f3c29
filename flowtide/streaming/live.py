"""Live sets: sets that only grow, with views and rules that see every element once; in memory of a run, or over a stream."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import figures
from ..plans.fixpoint import delete, lacking, near, scratch, stored, tiered


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


class LiveSet:
    """A set of rows of one schema, nulls being equal. `total` is what is known; `added` is what no rule has seen yet.

    kept: tables of rows that are known from before and that all rules have seen.
    """

    def __init__(self, rows: DataFrame, kept: list[DataFrame] | None = None):
        self.empty, self.kept, self.parts, self.rules = rows.where("false"), kept or [], [], {}
        self.taken()
        self.offer(rows)

    @property
    def total(self) -> DataFrame:
        return _union([*self.kept, *self.fresh]) if self.kept or self.parts else self.empty

    @property
    def fresh(self) -> list[DataFrame]:
        """Tables of what has come since the set was made."""
        return [df for df, _ in self.parts]

    def offer(self, rows: DataFrame, log: figures.Rounds | None = None) -> int:
        """Adds what is new of rows; how many those are.

        What is found is compared with the rows known between its least and greatest whole numbers; where there are none, all is new and nothing is written again.
        """
        new = stored(figures.counted(log, rows.select(self.empty.columns)).distinct())
        n, known = near(new, self.total)
        if n and (self.kept or self.parts) and not known.isEmpty():
            new = stored(lacking(new, known))
            n = new.count()
        if n:
            self.parts = tiered([*self.parts, (new, n)])
            self.added, self.unseen = self.added.unionByName(new) if self.unseen else new, self.unseen + n
        return n

    def taken(self) -> None:
        self.added, self.unseen = self.empty, 0

    def on_add(self, tag, rule: Callable[[DataFrame], tuple[LiveSet, DataFrame]]) -> None:
        """rule maps new rows to (a set, rows for it). It sees all present rows first, later ones as they come; a tag counts once."""
        self.rules.setdefault((tag, "self"), [rule, False])

    def map(self, tag, f: Callable[[DataFrame], DataFrame], rule, view: str | None = None) -> None:
        """A rule on the view f of this set; the same tag on another view is another rule. Views are told apart by name, those without one by f."""
        self.rules.setdefault((tag, view or f), [lambda new: rule(f(new).distinct()), False])


def settle(*sets: LiveSet, log: figures.Rounds | None = None) -> int:
    """Runs all rules of the sets until nothing is new; returns the number of rounds. log takes the figures of each."""
    rounds = 0
    while True:
        gained: dict[int, tuple[LiveSet, list]] = {}
        with figures.one(log) as row:
            for s in sets:
                for entry in s.rules.values():
                    rule, begun = entry
                    if begun and not s.unseen:
                        continue
                    target, rows = rule(s.added if begun else s.total)
                    gained.setdefault(id(target), (target, []))[1].append(rows)
                    entry[1] = True
            row["asked"] = sum(s.unseen for s in sets)
            for s in sets:
                s.taken()
            found = row["found"] = sum(target.offer(_union(rows), log) for target, rows in gained.values())
        rounds += 1
        if not found:
            return rounds


COMMIT = "batch long, runs map<string,array<struct<first:long,last:long,batches:long>>>, begun array<string>, obsolete array<string>"


@dataclass
class Settling:
    """For `foreachBatch`: live sets that take up each micro-batch, settle, and are found again after a restart.

    feed maps a micro-batch to rows for sets by name; rules registers the rules on the sets, each time anew: tags and the names of
    views tell which ones are known. What a batch adds is written as a run of each set, and one row, written last, makes the batch
    count: a batch that is given again after a failure begins from what the one before had left, and one that counts is passed over. So every rule
    sees every row once in what counts; a rule that is new after a restart sees all rows first, with the next batch.
    Runs of as many batches are merged like the digits of a binary number: there are as many as the number of batches has
    digits, and a row is rewritten as often at most. A batch scans the sets once a round, and shuffles what is new.
    """

    folder: str
    schemas: dict[str, str]
    feed: Callable[[DataFrame], dict[str, DataFrame]]
    rules: Callable[[dict[str, LiveSet]], None]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, last = batch.sparkSession, self._last(batch.sparkSession)
        if last is not None and batch_id <= last.batch:
            return
        for folder in last.obsolete if last else ():
            delete(spark, folder)
        with scratch(batch):
            log = figures.Rounds(spark)
            sets = {name: LiveSet(self._none(spark, name), self._kept(spark, last, name)) for name in self.schemas}
            self.rules(sets)
            rules = {self._key(name, *key): entry for name, s in sets.items() for key, entry in s.rules.items()}
            for key, entry in rules.items():
                entry[1] = last is not None and key in last.begun
            for name, rows in self.feed(batch).items():
                sets[name].offer(rows)
            settle(*sets.values(), log=log)
            runs, obsolete = {}, []
            for name, s in sets.items():
                runs[name], gone = self._write(batch_id, name, s, [(r.first, r.last, r.batches) for r in last.runs[name]] if last else [])
                obsolete += gone
            log.table().withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/figures/{batch_id}")
        begun = sorted(set(rules) | set(last.begun if last else ()))
        spark.createDataFrame([(batch_id, runs, begun, obsolete)], COMMIT).coalesce(1).write.mode("overwrite").parquet(self._slot(batch_id))

    def totals(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The sets as the last batch that counts left them."""
        last = self._last(spark)
        return {name: _union([self._none(spark, name), *self._kept(spark, last, name)]) for name in self.schemas}

    def rounds(self, spark: SparkSession) -> DataFrame:
        """The figures of each round of each batch."""
        return spark.read.schema(f"{figures.ROUND}, batch long").option("recursiveFileLookup", "true").parquet(f"{self.folder}/figures")

    @staticmethod
    def _key(name: str, tag, view) -> str:
        if not isinstance(view, str):
            raise ValueError(f"the view of rule {tag!r} of {name} has no name")
        return f"{name}|{tag}|{view}"

    def _slot(self, batch_id: int) -> str:
        """Commits go to two places in turn, so that the one before is there while one is written."""
        return f"{self.folder}/commits/{batch_id % 2}"

    def _last(self, spark: SparkSession):
        found = []
        for slot in (0, 1):
            try:
                found += spark.read.schema(COMMIT).parquet(self._slot(slot)).collect()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return max(found, key=lambda r: r.batch, default=None)

    def _none(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.createDataFrame([], self.schemas[name])

    def _run(self, name: str, first: int, last: int) -> str:
        return f"{self.folder}/sets/{name}/{first}-{last}"

    def _kept(self, spark: SparkSession, last, name: str) -> list[DataFrame]:
        return [spark.read.schema(self.schemas[name]).parquet(self._run(name, r.first, r.last)) for r in last.runs[name]] if last else []

    def _write(self, batch_id: int, name: str, s: LiveSet, runs: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[str]]:
        """Writes what the batch added, together with the last runs of as many batches; the runs now, and the folders they replace."""
        frames, first, size, gone = [s.empty, *s.fresh], batch_id, 1, []
        while runs and runs[-1][2] == size:
            *runs, (first, end, _) = runs
            frames.append(s.kept[len(runs)])
            gone.append(self._run(name, first, end))
            size *= 2
        _union(frames).write.mode("overwrite").parquet(self._run(name, first, batch_id))
        return [*runs, (first, batch_id, size)], gone


def arrivals(stream: DataFrame, key: list[str]) -> DataFrame:
    """The same novelty test on a Structured Streaming source: each key passes once, whatever batch it comes in."""
    return stream.dropDuplicates(key)


def status(s: LiveSet) -> DataFrame:
    return s.total.agg(F.count("*").alias("total"))
