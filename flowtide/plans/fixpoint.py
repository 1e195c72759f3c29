"""Recursive relations as semi-naive loops of DataFrame plans.

A round joins only what the last round added. Each round's addition is
materialised in the shared checkpoint folder, so a lost executor costs a reread
and plans stay short; the driver sees nothing but whether the addition is empty.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
import operator
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import figures

#: The folder of the tables of the work at hand, where it is to be deleted afterwards.
_SCRATCH: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def shared_folder(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one is made in local mode; on a cluster that is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder and drops its lineage."""
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut, as a written table: its size is known, so the optimizer broadcasts it in joins while it is small."""
    folder = f"{_SCRATCH.get() or shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(df: DataFrame):
    """What `stored` writes inside goes when the block is left: results that are still needed have to be read before."""
    folder = f"{shared_folder(df)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete(df.sparkSession, folder)


def lacking(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of found that known lacks; nulls are equal. found is to be a stored table.

    What both have is looked for first: known is only scanned, without a shuffle, while found is small enough to be broadcast.
    """
    same = lambda a, b: functools.reduce(operator.and_, (F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in found.columns))
    seen = known.select([f"`{c}`" for c in found.columns]).alias("k").join(found.alias("f"), same("k", "f"), "left_semi")
    return found.alias("f").join(seen.alias("s"), same("f", "s"), "left_anti")


#: Types of columns by whose least and greatest values rows are told apart.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def near(found: DataFrame, known: DataFrame) -> tuple[int, DataFrame]:
    """How many rows found has, and the rows of known between the least and greatest whole numbers of its columns: no others can equal one of found.

    found is to be a stored table. The bounds are pushed down to the files of known: those with no such row aren't read.
    """
    columns = [c for c, kind in found.dtypes if kind in WHOLE]
    ends = found.agg(F.count(F.lit(1)), *(f(f"`{c}`") for c in columns for f in (F.min, F.max, F.count))).first()
    for i, c in enumerate(columns):
        least, most, n = ends[3 * i + 1 : 3 * i + 4]
        at = F.col(f"`{c}`")
        inside = at.between(least, most) if n else F.lit(False)
        known = known.where(inside if n == ends[0] else inside | at.isNull())
    return ends[0], known


def tiered(parts: list[tuple[DataFrame, int]], most: int = 16) -> list[tuple[DataFrame, int]]:
    """As merged, once there are more than `most` parts of a size: a row is rewritten as often as the number of parts has digits, and not at all while they are few."""
    n, size = 0, 0
    while n < len(parts) and (not n or parts[-1 - n][1] < 2 * size):
        n, size = n + 1, size + parts[-1 - n][1]
    if n <= most:
        return parts
    return [*parts[:-n], (stored(functools.reduce(DataFrame.union, (df for df, _ in parts[-n:]))), size)]


def merged(parts: list[tuple[DataFrame, int]], factor: int = 4) -> list[tuple[DataFrame, int]]:
    """Tables with their sizes, the last ones merged while the one before is less than `factor` times as large: they stay few, and each row is rewritten seldom."""
    while len(parts) > 1 and parts[-2][1] < factor * parts[-1][1]:
        (a, n), (b, m) = parts[-2:]
        parts = [*parts[:-2], (a.union(b), n + m)]
        if len(parts) == 1 or parts[-2][1] >= factor * parts[-1][1]:
            parts[-1] = (stored(parts[-1][0]), parts[-1][1])
    return parts


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int | None = None, log: figures.Rounds | None = None) -> DataFrame:
    """The least relation that holds seed and all of step(added last, all so far); rows are a set.

    Columns must not be null: they are keys of the novelty test. `most_rounds`
    bounds the derivation depth where a caller wants that; `log` takes the figures of each round.
    """
    total = added = cut(seed.distinct())
    rounds = 0
    while (most_rounds is None or rounds < most_rounds) and not added.isEmpty():
        with figures.one(log) as row:
            found = figures.counted(log, step(added, total).select(total.columns)).distinct()
            added = cut(found.join(total, total.columns, "left_anti"))
            if log is not None:
                row["found"] = added.count()
        total = total.unionByName(added)
        rounds += 1
        if rounds % 8 == 0:
            total = cut(total)
    return total


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", within: DataFrame | None = None) -> DataFrame:
    """(src, dst) for every path of one edge or more; `within` (src) keeps the search to what is asked for."""
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    seed = pairs if within is None else pairs.join(within.select("src").distinct(), "src", "left_semi")
    hop = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    return fixpoint(seed, lambda new, _: new.join(hop, "dst").select("src", F.col("next").alias("dst")))


def _single(pairs: DataFrame) -> tuple[int, int, int]:
    """How many links (src, dst) there are, how many are the only one of their src, and of their dst."""
    one = lambda end: pairs.groupBy(end).count().where("count = 1").count()
    return pairs.count(), one("src"), one("dst")


def _further(pairs: DataFrame, jump: DataFrame) -> DataFrame:
    return pairs.join(jump.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()


#: Positions of a path that are joined in one group.
BLOCK = 4096


def _paths(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The closure of the links (src, dst) of paths that meet nowhere, and the links that are left: those of rings.

    Each node gets its path and its place on it; a node leads to all that are nearer to the end. Only links are shuffled, and pairs are
    made once, by a join in blocks, so that a path of any length is spread over tasks.
    """
    ends = links.select("dst").join(links.select("src"), F.col("dst") == F.col("src"), "left_anti").select(F.col("dst").alias("node"), F.lit(None).cast("long").alias("prev"))
    placed = stored(roots(links.select(F.col("src").alias("node"), F.col("dst").alias("prev")).union(ends)))
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    ahead = placed.select("root", block("hops").alias("block"), F.col("node").alias("dst"), F.col("hops").alias("left"))
    behind = placed.where("hops > 0").select("root", F.col("node").alias("src"), "hops", F.explode(F.sequence(F.lit(0).cast("long"), block("hops"))).alias("block"))
    rings = links.join(placed.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst")
    return behind.join(ahead, ["root", "block"]).where("hops > left").select("src", "dst"), rings


def closure_by_doubling(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """As closure; where every src or every dst has one edge, in as many rounds as the longest path has binary digits.

    Paths are gone along by their numbers. Else `jump` has the pairs joined by exactly 2**k edges, one for each src (or dst) at most, `total` those joined by 1 to 2**k; a
    round that adds nothing to `total` shows that it is closed. In other graphs `jump` could hold far more pairs than edges and answers: those go edge by edge.
    """
    jump = total = stored(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    n, by_src, by_dst = _single(jump)
    if n not in (by_src, by_dst):
        return closure(jump)
    paths = None
    if n == by_src == by_dst and dict(jump.dtypes)["src"] == "bigint":
        paths, rings = _paths(jump)
        jump = total = stored(rings)
    while True:
        added = cut(_further(total, jump).join(total, ["src", "dst"], "left_anti"))
        if added.isEmpty():
            return total if paths is None else paths.union(total)
        total, jump = cut(total.unionByName(added)), cut(_further(jump, jump))


#: Chains of fewer links are gone along link by link.
LONG_CHAIN = 16


def propagate(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the labels (node, label) of each node and of all that its links (src, dst) lead to.

    Links that are the only one of their src (or dst, whichever are more) form chains; along chains labels go by doubling, and from chain to chain
    link by link, each time only those that are new. No table holds more rows than links, labels and answers.
    """
    pairs = cut(links.select("src", "dst").where("src <> dst").distinct())
    n, by_src, by_dst = _single(pairs)
    end = "src" if by_src >= by_dst else "dst"
    only = pairs.groupBy(end).count().where("count = 1").select(end)
    jumps, rest = [cut(pairs.join(only, end, "left_semi"))], pairs.join(only, end, "left_anti")
    while 1 << len(jumps) <= max(by_src, by_dst):
        jump = cut(_further(jumps[-1], jumps[-1]))
        if jump.isEmpty():
            break
        jumps.append(jump)
    if 1 << len(jumps) <= LONG_CHAIN:
        jumps, rest = [], pairs
    rest = cut(rest)

    def along(found: DataFrame, by: DataFrame) -> DataFrame:
        return found.join(by.select(F.col("dst").alias("node"), "src"), "node").select(F.col("src").alias("node"), "label")

    new = cut(labels.select("node", "label").distinct())
    total, rounds = new.where("false"), 0
    while not new.isEmpty():
        for jump in jumps:
            new = cut(new.union(along(new, jump)).distinct())
        new = cut(new.join(total, ["node", "label"], "left_anti")) if rounds and jumps else new
        total, rounds = total.union(new), rounds + 1
        total = cut(total) if rounds % 8 == 0 else total
        new = cut(along(new, rest).distinct().join(total, ["node", "label"], "left_anti"))
    return total


def roots(links: DataFrame) -> DataFrame:
    """(node, root, hops) of functional links (node, prev), prev null at a root: pointer doubling, so rounds are few.

    A round joins and writes only the nodes that haven't come to a root yet. A cycle has no root; its nodes are left out.
    """
    own = links.where("prev is null").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("hops"))
    linked = links.where("prev is not null").select("node", F.col("prev").alias("to"), F.lit(1).cast("long").alias("hops"))
    # Links are told from roots once: what leads to a root is done.
    ends = links.where("prev is null").select(F.col("node").alias("to"), F.lit(True).alias("done"))
    now = stored(linked.join(ends, "to", "left").select("node", "to", "hops", F.coalesce("done", F.lit(False)).alias("done")))
    done, most, reach = [own, now.where("done").select("node", F.col("to").alias("root"), "hops")], now.count(), 1
    while reach <= most and not now.where("not done").isEmpty():
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("hops").alias("more"), F.col("done").alias("at_end"))
        moved = stored(now.where("not done").join(ahead, "to").select("node", F.col("further").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), F.col("at_end").alias("done")))
        done.append(moved.where("done").select("node", F.col("to").alias("root"), "hops"))
        now, reach = moved.union(now.where("done")), reach * 2
    return functools.reduce(DataFrame.union, done)
