"""Best-fit packing by a tree of residual bins.

Documents are tokenised where they are read and cut only where they are longer than a sequence. Whole sequences are done.
The other pieces are dealt by chance to nodes of about NODE pieces; each node packs its pieces best-fit, largest first. Bins with at most
NEAR free tokens are emitted; the emptiest of the others, KEEP a node, go to the node above as items, where FAN nodes' bins
are packed best-fit again, up to the root. Of two bins over half full neither takes the other, and a node has one bin at
most that is not, so that KEEP bins a node are more than its sisters can fill; bins beyond that are emitted as they are.
Only piece rows are shuffled, no texts or ids; a node holds NODE pieces or FAN * KEEP bins, whatever the corpus.

Cases: null text is empty and has the closing id 0 alone; repeated rows are packed each; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, session, stored, texts
from .packing import default_encoder
from .words import batches

LENGTH, END = 2048, 0
#: Pieces of a node on average, free tokens of an emitted bin, bins that a node hands up at most, and nodes below a node.
NODE, NEAR, KEEP, FAN = 4096, 16, 64, 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, serial long"
PACKED = f"{PIECES}, bin long, size long, offset long, node long, done boolean"


def cuts(tokens: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, before them what is over."""
    over = tokens % length
    at = list(range(over, tokens, length))
    return ([(0, over)] if over else []) + [(a, length) for a in at]


def pieces(docs: DataFrame, length: int, end: int, make_encoder) -> DataFrame:
    def rows(it):
        from pyspark import TaskContext

        encode, serial = make_encoder(), TaskContext.get().partitionId() << 40
        for batch in batches(it, "text"):
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end], "<u4")
                for i, (a, n) in enumerate(cuts(len(ids), length)):
                    out.append((doc, i, a, n, zlib.crc32(ids[a : a + n]), serial))
                    serial += 1
            columns = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32", "serial"])

    return texts(docs).mapInArrow(rows, PIECES)


def best_fit(sizes: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """The bin of each item, its place in it, and how full each bin is. Items are taken as they come."""
    free: list[list[int]] = [[] for _ in range(length + 1)]  # bins by free tokens
    some = 0  # bit r: a bin with r free tokens is there
    of, place, fill = [], [], []
    for size in sizes:
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b = length, len(fill)
            fill.append(0)
        of.append(b)
        place.append(fill[b])
        fill[b] += size
        if left := room - size:
            free[left].append(b)
            some |= 1 << left
    return of, place, fill


def _pack_node(rows: pa.Table, length: int, near: int, keep: int, root: bool) -> pa.Table:
    """Packs the bins of a node: rows by falling size, those of a bin together."""
    bins = rows["bin"].to_numpy()
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    item = np.cumsum(np.append(0, bins[1:] != bins[:-1]))
    of, place, fill = (np.array(x, np.int64) for x in best_fit(rows["size"].to_numpy()[first].tolist(), length))
    name = np.empty(len(fill), np.int64)
    name[of[::-1]] = bins[first][::-1]  # of its first item
    done = (length - fill <= near) | root
    rest = np.flatnonzero(~done)
    done[rest[np.argsort(fill[rest], kind="stable")][keep:]] = True
    columns = {c: rows[c] for c in rows.column_names} | {
        "bin": pa.array(name[of[item]]),
        "size": pa.array(fill[of[item]]),
        "offset": pa.array(rows["offset"].to_numpy() + place[item]),
        "done": pa.array(done[of[item]]),
    }
    return pa.table(columns)


def level(items: DataFrame, tasks: int, length: int, near: int, keep: int, root: bool) -> DataFrame:
    def rows(it):
        held: list[pa.RecordBatch] = []
        for batch in it:
            nodes = batch["node"].to_numpy()
            edges = [*(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
            at = 0
            for to in edges:
                if held and to > at and held[0]["node"][0] != batch["node"][at]:
                    yield from _pack_node(pa.Table.from_batches(held), length, near, keep, root).to_batches()
                    held = []
                if to > at:
                    held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield from _pack_node(pa.Table.from_batches(held), length, near, keep, root).to_batches()

    dealt = items.repartition(tasks, "node").sortWithinPartitions("node", F.col("size").desc(), "bin", "offset")
    return dealt.mapInArrow(rows, PACKED)


def pack_best_fit(docs: DataFrame, length: int = LENGTH, end: int = END, make_encoder=default_encoder, node: int = NODE, near: int = NEAR, keep: int = KEEP, fan: int = FAN) -> DataFrame:
    """Pieces of documents in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = session(docs)
    every = stored(pieces(docs, length, end, make_encoder))
    part = F.col("length") < length
    nodes = 1 + every.where(part).count() // node
    chance = F.pmod(F.xxhash64("serial"), F.lit(nodes))
    now = every.where(part).select("*", F.col("serial").alias("bin"), F.col("length").alias("size"), F.lit(0).cast("long").alias("offset"), chance.alias("node"), F.lit(False).alias("done"))
    out = [every.where(~part).select("*", F.col("serial").alias("bin"), F.lit(0).cast("long").alias("offset"))]
    while True:
        packed = stored(level(now, min(nodes, partitions(spark)), length, near, keep, nodes == 1))
        out.append(packed.where("done").select(out[0].columns))
        if nodes == 1:
            break
        nodes = -(-nodes // fan)
        now = packed.where("not done").withColumn("node", F.floor(F.col("node") / fan).cast("long"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
