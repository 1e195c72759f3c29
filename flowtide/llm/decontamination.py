"""Benchmark decontamination by a prefix-filtered set join with exact containment.

Every benchmark item is cut into windows of ten words (an item with fewer words
is one window). A window is a set of five-word shingles, ordered by how rarely
they occur in the whole corpus. Since a document must hold all shingles of a
window, the necessary prefix is the rarest one alone. A document position with
that shingle is a candidate; the shingle's place in the window and the ends of
the document bound where the window can lie, and the words there are compared
in full.

The benchmark's windows are broadcast only up to MAX_BLOCK bytes of item text; in arrays they take some
thirty times as much. A larger benchmark is handled in blocks of that size, exactly, over documents
that are materialised once with row numbers: each block reads them twice. A long item is cut into
segments that overlap by a window less a word, so that an item of any length fits.

Cases: null texts have no words; an item without words has no window; an item
with a null id marks words but isn't counted; repeated items count once by id;
repeated documents stay; empty tables give empty results or clean documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session, texts
from .words import LOWER_ALNUM, U, Words, batches, split, windows

WINDOW, SHINGLE = 10, 5
#: Bytes of item text whose windows are broadcast at once, and words of an item's segment.
MAX_BLOCK, SEGMENT = 8 << 20, 4096

ROW = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"


def _hash_at(hashes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """`windows` only at the given starts."""
    out = np.zeros(len(start), np.uint64)
    for j in range(n):
        out = out * U(0xA24BAED4963EE407) + hashes[start + j]
    from .words import mix

    return mix(out)


class Lookup:
    """Positions of values in a sorted array, with a bit table in front for the many that aren't there."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.values >> U(44)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in x, index in values) of what is there."""
        at = np.flatnonzero(self.bits[x >> U(44)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        to = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        ok = self.values[to] == x[at]
        return at[ok], to[ok]


class Windows:
    """The distinct windows of a block of items, before the rarity of their shingles is known.

    Windows are told apart by XXH3-128; documents' words are compared with `text`, their words with a space between.
    """

    def __init__(self, ids: list, items: list, window: int, shingle: int):
        words = split(pa.array(items, pa.large_string()), LOWER_ALNUM, True)
        hashes = words.hashes()
        counts = words.counts()
        size = np.minimum(counts, window)
        each = np.where(counts > 0, counts - size + 1, 0)  # windows of each item
        item = np.repeat(np.arange(len(counts)), each)
        at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + words.first[:-1][item]
        n = size[item]
        self.data, start, end = words.joined()
        low, high = start[at], end[at + n - 1]
        text, digest = self.data.tobytes(), xxhash.xxh3_128_digest
        digests = np.frombuffer(b"".join([digest(text[x:y]) for x, y in zip(low.tolist(), high.tolist(), strict=True)]), "V16")
        _, first, of = np.unique(digests.view([("a", "<u8"), ("b", "<u8")]), return_index=True, return_inverse=True)
        at = at[first]
        self.low, self.high, self.length = low[first], high[first], n[first]
        owners = np.unique(np.stack([of.ravel(), item], axis=1), axis=0)  # the items of each window
        self.owner_at = np.searchsorted(owners[:, 0], np.arange(len(at) + 1))
        names, known = {}, []
        for i in ids:
            known.append(-1 if i is None else names.setdefault(str(i), len(names)))
        self.names, self.owner = list(names), np.array(known, np.int64)[owners[:, 1]]
        self.hash = np.zeros(len(at), np.uint64)
        self.shingles: dict[int, np.ndarray] = {}  # by length of the window: the shingles at each offset
        for size in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == size)
            self.hash[own] = _hash_at(hashes, at[own], size)
            k = min(shingle, size)
            self.shingles[size] = np.stack([_hash_at(hashes, at[own] + o, k) for o in range(size - k + 1)], axis=1)
        self.shingle = shingle

    def all_shingles(self) -> dict[int, np.ndarray]:
        """Distinct shingles by their number of words."""
        out: dict[int, list] = {}
        for n, s in self.shingles.items():
            out.setdefault(min(self.shingle, n), []).append(s.ravel())
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


class Prefixes:
    """For each window its rarest shingle, sorted for lookups."""

    def __init__(self, w: Windows, counts: dict[int, np.ndarray]):
        every = w.all_shingles()
        self.data, self.low, self.high, self.length, self.hash = w.data.tobytes(), w.low, w.high, w.length, w.hash
        self.names, self.owner, self.owner_at = w.names, w.owner, w.owner_at
        self.by: dict[int, tuple] = {}
        rows: dict[int, list] = {}
        for n, s in w.shingles.items():
            k = min(w.shingle, n)
            rare = counts[k][np.searchsorted(every[k], s)]
            offset = rare.argmin(axis=1)
            rows.setdefault(k, []).append((s[np.arange(len(s)), offset], offset, np.flatnonzero(w.length == n)))
        for k, parts in rows.items():
            key, offset, entry = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.argsort(key, kind="stable")
            lookup = Lookup(key)
            self.by[k] = (lookup, np.append(np.searchsorted(key[order], lookup.values), len(key)), offset[order], entry[order])

    def items(self, entries) -> set[str]:
        """Ids of the items that hold any of these windows."""
        return {self.names[i] for e in set(entries) for i in self.owner[self.owner_at[e] : self.owner_at[e + 1]].tolist() if i >= 0}

    def hits(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        low = np.repeat(words.first[:-1], words.counts())
        high = np.repeat(words.first[1:], words.counts())
        starts, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (lookup, begin, offset, entry) in self.by.items():
            at, to = lookup.find(windows(hashes, k))
            n = begin[to + 1] - begin[to]
            each = np.repeat(begin[to] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            at = np.repeat(at, n)
            e = entry[each]
            start = at - offset[each]
            ok = (start >= low[at]) & (start + self.length[e] <= high[at])  # the window lies inside the document
            starts.append(start[ok])
            entries.append(e[ok])
        start, entry = np.concatenate(starts), np.concatenate(entries)
        same = np.zeros(len(start), bool)
        for n in np.unique(self.length[entry]).tolist():
            own = np.flatnonzero(self.length[entry] == n)
            same[own] = _hash_at(hashes, start[own], n) == self.hash[entry[own]]
        likely = np.flatnonzero(same)
        if len(likely):  # compared in full
            joined, first, last = words.joined()
            joined = joined.tobytes()
            spans = zip(first[start[likely]].tolist(), last[start[likely] + self.length[entry[likely]] - 1].tolist(), self.low[entry[likely]].tolist(), self.high[entry[likely]].tolist(), strict=True)
            same[likely] = [joined[a:b] == self.data[c:d] for a, b, c, d in spans]
        return start[same], entry[same]


def _rarity(docs: DataFrame, w: Windows) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""
    every = w.all_shingles()
    shared = docs.sparkSession.sparkContext.broadcast(every)

    def rows(it):
        tables = {k: Lookup(v) for k, v in shared.value.items()}
        count = {k: np.zeros(len(t.values), np.int64) for k, t in tables.items()}
        for batch in batches(it, "text"):
            hashes = split(batch["text"], LOWER_ALNUM, True).hashes()  # shingles across texts only blur the order
            for k, t in tables.items():
                count[k] += np.bincount(t.find(windows(hashes, k))[1], minlength=len(t.values))
        for k, c in count.items():
            at = np.flatnonzero(c)
            yield pa.record_batch({"k": pa.array(np.full(len(at), k)), "i": pa.array(at), "n": pa.array(c[at])})

    found = docs.select("text").mapInArrow(rows, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()
    out = {k: np.zeros(len(v), np.int64) for k, v in every.items()}
    for k, i, n in found:
        out[k][i] = n
    return out


def _spans(it, prefixes: Prefixes):
    """(batch, words, first word of each occurrence, its window)."""
    for batch in batches(it, "text"):
        words = split(batch["text"], LOWER_ALNUM, True)
        start, entry = prefixes.hits(words, words.hashes())
        yield batch, words, start, entry


def segments(items: DataFrame, window: int, words_each: int = SEGMENT) -> DataFrame:
    """(item_id, text) of the items' segments; those without words are left out."""

    def rows(it):
        for batch in batches(it, "text"):
            words = split(batch["text"], LOWER_ALNUM, True)
            data, start, end = words.joined()
            text = data.tobytes()
            of, parts = [], []
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                while a < b:
                    to = min(b, a + words_each + window - 1)
                    of.append(i)
                    parts.append(text[start[a] : end[to - 1]].decode())
                    a = b if to == b else a + words_each
            yield pa.record_batch({"item_id": batch["item_id"].take(pa.array(of, pa.int64())), "text": pa.array(parts, pa.string())})

    return items.where("text is not null").mapInArrow(rows, f"item_id {items.schema['item_id'].dataType.simpleString()}, text string")


def _block(docs: DataFrame, items: DataFrame, window: int, shingle: int):
    rows = items.collect()
    w = Windows([r[0] for r in rows], [r[1] for r in rows], window, shingle)
    return docs.sparkSession.sparkContext.broadcast(Prefixes(w, _rarity(docs, w)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, max_block: int = MAX_BLOCK, segment: int = SEGMENT, carry: str | None = None) -> DataFrame:
    """For each document: n_words, n_hit, n_items, items_sha256, contaminated and item_ids (sorted as strings), and the binary column `carry`."""
    session(docs)
    carried = (carry,) if carry else ()
    docs = texts(docs, carry=carried)
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = cut(segments(items, window, segment))
    size = items.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    n = 1 + size // max_block
    if n > 1:
        return _in_blocks(docs, items, window, shingle, 2 * n, carried)
    shared = _block(docs, items, window, shingle)

    def rows(it):
        prefixes = shared.value
        for batch, words, start, entry in _spans(it, prefixes):
            counts = words.counts()
            depth = np.zeros(len(words.start) + 1, np.int32)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + prefixes.length[entry], -1)
            hit = np.append(np.cumsum(depth[:-1]) > 0, False).astype(np.int64)
            n_hit = np.where(counts > 0, np.add.reduceat(hit, words.first[:-1]), 0)
            found: list[set] = [set() for _ in range(batch.num_rows)]
            for d, e in zip((np.searchsorted(words.first, start, "right") - 1).tolist(), entry.tolist(), strict=True):
                found[d].add(e)
            yield _result(batch, counts, n_hit, [sorted(prefixes.items(x)) for x in found], carried)

    return docs.mapInArrow(rows, ROW + "".join(f", {c} binary" for c in carried))


def _result(batch: pa.RecordBatch, counts, n_hit, items: list[list[str]], carried: tuple[str, ...] = ()) -> pa.RecordBatch:
    return pa.record_batch({
        "doc_id": batch["doc_id"],
        "n_words": pa.array(counts, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(x) for x in items], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
        "contaminated": pa.array(np.asarray(n_hit) > 0, pa.bool_()),
        "item_ids": pa.array(items, pa.list_(pa.string())),
    } | {c: batch[c] for c in carried})


def _in_blocks(docs: DataFrame, items: DataFrame, window: int, shingle: int, n: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """As decontaminate, for a benchmark in n blocks: the hits of each row are gathered over the blocks, one entry each."""
    docs = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    found = None
    for i in range(n):
        shared = _block(docs, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i), window, shingle)

        def rows(it, shared=shared):
            prefixes = shared.value
            for batch, words, start, entry in _spans(it, prefixes):
                d = np.searchsorted(words.first, start, "right") - 1
                for r in np.unique(d).tolist():
                    own = d == r
                    ids = sorted(prefixes.items(entry[own].tolist()))
                    spans = np.stack([start[own] - words.first[r], prefixes.length[entry[own]]], axis=1)
                    yield pa.record_batch({"row": batch["row"].slice(r, 1), "spans": pa.array([spans.astype(np.int64).tobytes()], pa.binary()), "ids": pa.array([ids], pa.list_(pa.string()))})

        part = docs.mapInArrow(rows, "row long, spans binary, ids array<string>")
        found = part if found is None else found.union(part)
    gathered = found.groupBy("row").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))

    def final(it):
        for batch in batches(it, "text"):
            counts = split(batch["text"], LOWER_ALNUM, True).counts()
            n_hit = []
            for total, blobs in zip(counts.tolist(), batch["spans"].to_pylist(), strict=True):
                hit = np.zeros(total, bool)
                for blob in blobs or ():
                    for a, size in np.frombuffer(blob, np.int64).reshape(-1, 2).tolist():
                        hit[a : a + size] = True
                n_hit.append(int(hit.sum()))
            yield _result(batch, counts, n_hit, [x or [] for x in batch["ids"].to_pylist()], carried)

    return docs.join(gathered, "row", "left").select("doc_id", "text", "spans", "ids", *carried).mapInArrow(final, ROW + "".join(f", {c} binary" for c in carried))
