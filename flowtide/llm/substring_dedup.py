"""Substring deduplication over a log-structured index of window fingerprints.

The fingerprint space is cut into ranges by its top bits. Each range of the
index is a set of sorted immutable runs; documents arrive as batches in doc_id
order, every batch is merge-joined with the runs of its range, matches are
verified, and what is new becomes a run of its
own. Runs of like size are compacted. A compacted index can be stored and given
to a later increment as `history`.

A window is known by 96 bits: a 64-bit key, and 32 bits of a second digest that verify it.
Both are made of digests of whole words, the two of independent halves of each word's XXH3-128. Among 10**13
different windows, about what 100 TB hold, the chance that any two agree in all bits is below 0.1 %.

Only packed fingerprints and bitmaps travel between the documents and the
index: a batch asks each range once for its distinct windows, so a window that
a third of all documents share costs one entry per batch. Batches hold BATCH_BYTES each, in large corpora
up to MOST_BYTES, and the number of ranges grows with the windows, so that tasks stay
as small in a corpus of any size.

Cases: null text has no words; repeated rows of one doc_id are one document
for the purpose of "earlier", and stand in one batch; a null doc_id is later than every other, and null ones take
nothing from each other; texts of
fewer words than a window lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, session, texts
from .words import U, Words, inner_starts, split, windows

WINDOW = 13
#: Bytes of text of a batch: as many as give BATCHES of them, between these bounds.
BATCH_BYTES, MOST_BYTES, BATCHES = 6 << 20, 32 << 20, 4096
#: Windows of a range of the index, about, and bytes of text for each window.
RANGE_WINDOWS, WORD_BYTES = 8 << 20, 6
#: Null doc_ids come last, in batches from NULLS on.
LAST, NULLS = np.iinfo(np.int64).max, 1 << 40

CHECK = np.uint32
RUN_SCHEMA = "range long, batch long, keys binary, checks binary"


# -- packed fingerprints ------------------------------------------------------


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences in byte planes: the high planes are zero and compress in the shuffle."""
    steps = np.diff(keys, prepend=U(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


class Batch:
    """The windows of one batch of documents: `keys` and `checks` are distinct and sorted, `of` maps windows to them."""

    def __init__(self, table: pa.Table, window: int):
        ids = table["doc_id"].to_numpy(zero_copy_only=False) if not table["doc_id"].null_count else table["doc_id"].fill_null(LAST).to_numpy()
        self.words: Words = split(table["text"])
        first, second = self.words.digests()
        self.at = np.flatnonzero(inner_starts(self.words, window)[: max(0, len(first) - window + 1)])
        key = windows(first, window)[self.at]
        check = (windows(second, window, 0x9FB21C651E98DF25)[self.at] >> U(32)).astype(CHECK)
        doc = ids.astype(np.int64)[np.repeat(np.arange(table.num_rows), self.words.counts())[self.at]]
        order = np.lexsort((check, key))
        key, check, doc = key[order], check[order], doc[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        first = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        self.keys, self.checks = key[first], check[first]
        self.of = np.empty(len(key), np.int64)
        self.of[order] = group
        lowest = np.minimum.reduceat(doc, first) if len(first) else doc
        self.later = np.zeros(len(key), bool)
        self.later[order] = doc > lowest[group]

    def ranges(self, bits: int) -> np.ndarray:
        """Where each range of the index begins in `keys`."""
        edges = np.arange(1 << bits, dtype=np.uint64) << U(64 - bits) if bits else np.zeros(1, np.uint64)
        return np.append(np.searchsorted(self.keys, edges), len(self.keys))


# -- the index ----------------------------------------------------------------


class Runs:
    """Sorted immutable runs of one range: newer runs are smaller, and like-sized ones are compacted."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def seen(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for have, verify in self.runs:
            at = np.searchsorted(have, keys)
            left = np.flatnonzero(at < len(have))
            while len(left):  # equal keys stand together; one step, unless different windows share a key
                left = left[have[at[left]] == keys[left]]
                found[left] |= verify[at[left]] == checks[left]
                at[left] += 1
                left = left[~found[left] & (at[left] < len(have))]
        return found

    def add(self, keys: np.ndarray, checks: np.ndarray) -> None:
        if not len(keys):
            return
        self.runs.append((keys, checks))
        while len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
            self.compact(2)

    def compact(self, last: int | None = None) -> None:
        """Merges the newest runs (all, if `last` isn't given) into one."""
        taken = self.runs[-last:] if last else self.runs
        if len(taken) < 2:
            return
        keys, checks = (np.concatenate([run[i] for run in taken]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        self.runs[len(self.runs) - len(taken) :] = [(keys[order], checks[order])]


def _ordered(table: pa.Table):
    for row in np.argsort(table["batch"].to_numpy(), kind="stable").tolist():
        yield table["batch"][row].as_py(), unpack(table["keys"][row].as_py()), np.frombuffer(table["checks"][row].as_py(), CHECK)


def _answers(key, table):
    """For each batch, in order, which of its keys an earlier batch or the history has."""
    runs, batches, bits = Runs(), [], []
    for batch, keys, checks in _ordered(table):
        seen = runs.seen(keys, checks)
        if batch < NULLS:
            runs.add(keys[~seen], checks[~seen])
        if batch >= 0:
            batches.append(batch)
            bits.append(np.packbits(seen).tobytes())
    return pa.table({"batch": pa.array(batches, pa.int64()), "range": pa.array([key[0].as_py()] * len(batches), pa.int64()), "seen": pa.array(bits, pa.binary())})


def _merged(key, table):
    runs = Runs()
    for _, keys, checks in _ordered(table):
        seen = runs.seen(keys, checks)
        runs.add(keys[~seen], checks[~seen])
    runs.compact()
    keys, checks = runs.runs[0] if runs.runs else (np.zeros(0, np.uint64), np.zeros(0, CHECK))
    return pa.table({"range": pa.array([key[0].as_py()], pa.int64()), "batch": pa.array([-1], pa.int64()), "keys": pa.array([pack(keys)], pa.binary()), "checks": pa.array([checks.tobytes()], pa.binary())})


def compact(*runs: DataFrame) -> DataFrame:
    """One run per range out of stored or fresh runs, to be written and given as `history` later."""
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    return every.groupBy("range").applyInArrow(_merged, RUN_SCHEMA)


# -- documents ----------------------------------------------------------------


def _bounds(docs: DataFrame, batch_bytes: int) -> np.ndarray:
    """The first doc_id of every batch but the first. A range of narrow rows is summed up by a task; one number a batch comes to the driver."""
    narrow = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))

    def firsts(it):
        """(first doc_id, bytes) of runs of doc_ids with batch_bytes at most, or one larger document."""
        out = [[None, 0]]
        now, own = None, 0  # the doc_id that is being summed up

        def add():
            if out[-1][0] is None:
                out[-1][0] = now
            elif out[-1][1] + own > batch_bytes:
                out.append([now, 0])
            out[-1][1] += own

        for batch in it:
            ids, sizes = batch["doc_id"].to_numpy(), batch["size"].to_numpy()
            at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            for i, size in zip(ids[at].tolist(), np.add.reduceat(sizes, at).tolist() if len(at) else (), strict=True):
                if i != now:
                    if now is not None:
                        add()
                    now, own = i, 0
                own += size
        if now is not None:
            add()
            yield pa.record_batch({"doc_id": pa.array([x for x, _ in out], pa.int64()), "size": pa.array([n for _, n in out], pa.int64())})

    ranges = narrow.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    found = sorted(map(tuple, ranges.mapInArrow(firsts, "doc_id long, size long").collect()))
    out, size = [], 0
    for i, (first, own) in enumerate(found):
        if i and size + own > batch_bytes:
            out.append(first)
            size = 0
        size += own
    return np.array(out, np.int64)


def in_batches(docs: DataFrame, batch_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Documents with a batch number that ascends with doc_id, and the bytes of all texts; a batch holds batch_bytes at most or one document."""
    size = F.sum(F.octet_length("text").cast("long"))
    total, of_nulls = docs.agg(F.coalesce(size, F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text").cast("long"))), F.lit(0))).first()
    batch_bytes = batch_bytes or min(MOST_BYTES, max(BATCH_BYTES, total // BATCHES))
    bounds = docs.sparkSession.sparkContext.broadcast(_bounds(docs, batch_bytes))
    columns = [c for c in docs.columns if c != "batch"]

    def rows(it):
        for batch in it:
            ids = batch["doc_id"].fill_null(LAST).to_numpy()
            number = np.where(batch["doc_id"].is_null().to_numpy(zero_copy_only=False), NULLS + batch["part"].to_numpy(), np.searchsorted(bounds.value, ids, "right"))
            yield pa.record_batch([*(batch[c] for c in columns), pa.array(number)], [*columns, "batch"])

    parted = docs.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(1 + of_nulls // batch_bytes)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", batch long"
    return parted.mapInArrow(rows, schema), total


def asks(batched: DataFrame, bits: int, window: int = WINDOW) -> DataFrame:
    """The distinct fingerprints of each batch, by range of the index: runs, if they are stored."""

    def one(key, table):
        batch = Batch(table, window)
        edge = batch.ranges(bits)
        used = [r for r in range(len(edge) - 1) if edge[r] < edge[r + 1]]
        return pa.table({
            "range": pa.array(used, pa.int64()),
            "batch": pa.array([key[0].as_py()] * len(used), pa.int64()),
            "keys": pa.array([pack(batch.keys[edge[r] : edge[r + 1]]) for r in used], pa.binary()),
            "checks": pa.array([batch.checks[edge[r] : edge[r + 1]].tobytes() for r in used], pa.binary()),
        })

    return batched.groupBy("batch").applyInArrow(one, RUN_SCHEMA)


def substring_dedup(docs: DataFrame, window: int = WINDOW, history: DataFrame | None = None, bits: int | None = None, batch_bytes: int | None = None, with_text: bool = True, carry: str | None = None) -> DataFrame:
    """Removes every word in a window of `window` words that also starts in an earlier document.

    Returns doc_id, n_words, n_removed, kept_sha256, the binary column `carry` and, with_text, kept_text:
    the original text where nothing was removed, else the kept words joined by
    one space. `history` has the runs of earlier increments, made with the same
    `bits`; all its documents count as earlier.
    """
    spark = session(docs)
    carried = (carry,) if carry else ()
    batched, size = in_batches(texts(docs, carry=carried), batch_bytes)
    if bits is None:
        bits = (max(1 + size // (WORD_BYTES * RANGE_WINDOWS), partitions(spark)) - 1).bit_length()
    asked = asks(batched, bits, window)  # the same rows as below, shuffled once
    if history is not None:
        asked = asked.unionByName(history.select("range", F.lit(-1).cast("long").alias("batch"), "keys", "checks"))
    answers = asked.groupBy("range").applyInArrow(_answers, "batch long, range long, seen binary")

    def final(left, right):
        batch = Batch(left, window)
        edge = batch.ranges(bits)
        seen = np.zeros(len(batch.keys), bool)
        for r, data in zip(right["range"].to_pylist(), right["seen"].to_pylist(), strict=True):
            seen[edge[r] : edge[r + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=int(edge[r + 1] - edge[r])).view(bool)
        hit = batch.at[seen[batch.of] | batch.later]
        words = batch.words
        depth = np.zeros(len(words.start) + 1, np.int32)
        np.add.at(depth, hit, 1)
        np.add.at(depth, hit + window, -1)
        gone = np.cumsum(depth[:-1]) > 0
        counts = words.counts()
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) * (counts > 0) if left.num_rows else counts
        size = np.where(gone, 0, words.end - words.start + 1)
        at = np.append(0, np.cumsum(size))
        kept = _kept(words, gone)
        digests, out = [], []
        first = words.first
        for i in range(left.num_rows):
            text = kept[at[first[i]] : max(at[first[i]], at[first[i + 1]] - 1)]
            digests.append(hashlib.sha256(text).hexdigest())
            if with_text:
                out.append(bytes(text).decode("utf-8", "replace") if removed[i] else left["text"][i].as_py())
        result = {"doc_id": left["doc_id"], "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())} | {c: left[c] for c in carried}
        return pa.table(result | ({"kept_text": pa.array(out, pa.string())} if with_text else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + "".join(f", {c} binary" for c in carried) + (", kept_text string" if with_text else "")
    return batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(final, schema)


def _kept(words: Words, gone: np.ndarray) -> memoryview:
    """Kept words of the whole batch, each followed by a space."""
    return memoryview(Words(words.data, words.start[~gone], words.end[~gone], words.first).joined()[0].tobytes())
