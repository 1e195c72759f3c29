"""Ranked lexical search: TPUT over postings that are partitioned by term.

The terms of the queries (a benchmark's items) are a table of known size; items beyond MAX_TERMS terms are searched in
blocks. The corpus is read once a block: each document's counts of those terms are stored (the forward table), and from
it lists of (row, impact), sorted by impact, one for each term and each block of up to BLOCK documents, so that a list of a
very common term is many lists; they are dealt out by term and block. Then, with m lists of an item and k answers asked for:

1. Heads: the k best entries of each term. The exact scores of their documents give tau, a lower bound of the item's k-th score.
2. Threshold: a document without an entry of tau / m or more in some list of the item scores less than tau. Every list gives
   the entries that reach the threshold; their sums are lower bounds, and what an unseen list can still add gives upper bounds.
   The k-th lower bound raises tau.
3. Look-up: documents with an upper bound of tau or more get their exact scores from the forward table.

Thresholds keep equal scores, so that ties are whole. All scores are 64-bit integers.

Cases: null texts have no terms; documents and items without terms have no rows; repeated documents and repeated items are
rows of their own; equal scores stand by doc_id, null last; an empty table on either side gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import session, stored, texts
from .words import LOWER_ALNUM, batches, split

#: Answers of each item, distinct terms of a block of items, and documents of a block of lists.
TOP, MAX_TERMS, BLOCK = 20, 500_000, 1 << 16

FORWARD = "row long, doc_id long, n long, terms array<int>, counts array<int>"
LISTS = "term int, block long, rows binary, impacts binary"


class Items:
    """A block of items: their terms by number, and how often each item holds them."""

    def __init__(self, rows: list[tuple], field: pa.DataType):
        every = Counter(t for _, terms in rows for t in terms)
        self.vocabulary = sorted(every)
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.ids = pa.array([i for i, _ in rows], field)
        self.terms: list[np.ndarray] = []  # of each item, ascending
        self.times: list[np.ndarray] = []
        for _, terms in rows:
            counts = sorted((number[t], c) for t, c in Counter(terms).items())
            self.terms.append(np.array([t for t, _ in counts], np.int64))
            self.times.append(np.array([c for _, c in counts], np.int64))
        self.weight = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, documents: int, df: np.ndarray) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def factors(self, item: int) -> np.ndarray:
        """What an impact of each term of the item is multiplied with."""
        return self.times[item] * self.weight[self.terms[item]]


def impacts(counts: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The part of a score that the term's weight is multiplied with."""
    m = 100 - 25 + (25 * n * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, terms) of every item with a term."""
    item_id = benchmark.schema["item_id"].dataType.simpleString()

    def rows(it):
        for batch in batches(it, "text"):
            words = split(batch["text"], LOWER_ALNUM, True)
            data, start, end = words.joined()
            text = data.tobytes()
            every = [text[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            terms = [every[a:b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
            yield pa.record_batch({"item_id": batch["item_id"], "terms": pa.array(terms, pa.list_(pa.string()))})

    slim = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, f"item_id {item_id}, terms array<string>").where("size(terms) > 0")


def forward(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Of every document with a term: its number of terms, and how often it holds those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(it):
        from pyspark import TaskContext

        known = pa.array([f"{t} ".encode() for t in shared.value], pa.large_binary())
        row = TaskContext.get().partitionId() << 40
        for batch in batches(it, "text"):
            words = split(batch["text"], LOWER_ALNUM, True)
            data, start, _ = words.joined()  # each word with a space after it
            offsets = np.append(start, len(data)).astype(np.int64)
            each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            term = pc.fill_null(pc.index_in(each, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            n = words.counts()
            doc = words.doc()
            pairs, counts = np.unique(doc[term >= 0] * len(known) + term[term >= 0], return_counts=True)
            doc, term = pairs // max(1, len(known)), pairs % max(1, len(known))
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            table = pa.record_batch({
                "row": pa.array(row + np.arange(batch.num_rows)),
                "doc_id": batch["doc_id"],
                "n": pa.array(n, pa.int64()),
                "terms": pa.ListArray.from_arrays(pa.array(first), pa.array(term, pa.int32())),
                "counts": pa.ListArray.from_arrays(pa.array(first), pa.array(counts, pa.int32())),
            })
            row += batch.num_rows
            yield table.filter(pa.array(n > 0))

    return texts(docs).mapInArrow(rows, FORWARD)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the row in the batch, term, count) of all entries of a batch of the forward table."""
    terms, counts = batch["terms"], batch["counts"]
    sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(batch.num_rows), sizes), terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    def count(it):
        out = np.zeros(size, np.int64)
        for batch in it:
            out += np.bincount(batch["terms"].flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(out)
        yield pa.record_batch({"term": pa.array(at, pa.int32()), "n": pa.array(out[at])})

    df = np.zeros(size, np.int64)
    for term, n in rows.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # a row a term of the block
        df[term] = n
    return df


def _segments(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in a sorted array."""
    fresh = np.flatnonzero(key[1:] != key[:-1]) + 1
    return (np.append(0, fresh), np.append(fresh, len(key))) if len(key) else (fresh, fresh)


def posting_lists(rows: DataFrame, documents: int, total: int, per_block: int) -> DataFrame:
    """The list of every (term, block of documents), best impacts first. A block is of up to per_block documents that are read together."""

    def lists(held: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        terms, every, found = [], [], []
        for batch in held:
            place, term, counts = _flat(batch)
            terms.append(term)
            every.append(batch["row"].to_numpy()[place])
            found.append(impacts(counts, batch["n"].to_numpy()[place], documents, total).astype(np.int32))
        term, row, impact = (np.concatenate(x) for x in (terms, every, found))
        order = np.lexsort((row, -impact, term))
        term, row, impact = term[order], row[order], impact[order]
        first, last = _segments(term)
        spans = list(zip(first.tolist(), last.tolist(), strict=True))
        return pa.record_batch({
            "term": pa.array(term[first], pa.int32()),
            "block": pa.array(np.full(len(first), block)),
            "rows": pa.array([row[a:b].tobytes() for a, b in spans], pa.binary()),
            "impacts": pa.array([impact[a:b].tobytes() for a, b in spans], pa.binary()),
        })

    def parts(it):
        from pyspark import TaskContext

        block, held, n = TaskContext.get().partitionId() << 40, [], 0
        for batch in it:
            for at in range(0, batch.num_rows, per_block):
                part = batch.slice(at, per_block)
                if held and n + part.num_rows > per_block:
                    yield lists(held, block)
                    block, held, n = block + 1, [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield lists(held, block)

    return rows.mapInArrow(parts, LISTS).repartition("term", "block")


def _best(df: DataFrame, key: str, value: str, k: int, *ties) -> DataFrame:
    """The k rows of each key with the highest values, numbered from 1 as `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(value).desc(), *ties))).where(F.col("rank") <= k)


def exact(pairs: DataFrame, rows: DataFrame, shared, documents: int, total: int) -> DataFrame:
    """(item, row, doc_id, score) of each pair (item, row), the scores from the forward table."""

    def scores(it):
        items: Items = shared.value
        factors = [items.factors(i) for i in range(len(items.terms))]
        impact_of = np.zeros(len(items.vocabulary), np.int64)  # in the document at hand
        for batch in it:
            place, term, counts = _flat(batch)
            impact = impacts(counts, batch["n"].to_numpy()[place], documents, total)
            first = np.searchsorted(place, np.arange(batch.num_rows + 1)).tolist()
            asked = batch["items"].to_pylist()
            found = []
            for a, b, own in zip(first[:-1], first[1:], asked, strict=True):
                impact_of[term[a:b]] = impact[a:b]
                begin = np.cumsum([0] + [len(factors[i]) for i in own[:-1]])
                found.append(np.add.reduceat(impact_of[np.concatenate([items.terms[i] for i in own])] * np.concatenate([factors[i] for i in own]), begin))
                impact_of[term[a:b]] = 0
            each = np.array([len(x) for x in asked], np.int64)
            of = pa.array(np.repeat(np.arange(batch.num_rows), each))
            score = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.record_batch({"item": batch["items"].flatten(), "row": batch["row"].take(of), "doc_id": batch["doc_id"].take(of), "score": pa.array(score)})

    return rows.where("size(terms) > 0").join(pairs.groupBy("row").agg(F.collect_set("item").alias("items")), "row").mapInArrow(scores, "item int, row long, doc_id long, score long")


def heads(lists: DataFrame, k: int) -> DataFrame:
    """(term, row): the k best entries of each term."""

    def first(it):
        for batch in it:
            term, row, impact = [], [], []
            for t, r, i in zip(*(batch[c].to_pylist() for c in ("term", "rows", "impacts")), strict=True):
                r, i = np.frombuffer(r, np.int64)[:k], np.frombuffer(i, np.int32)[:k]
                term.append(np.full(len(r), t, np.int32))
                row.append(r)
                impact.append(i)
            if term:
                yield pa.record_batch({"term": pa.array(np.concatenate(term)), "row": pa.array(np.concatenate(row)), "impact": pa.array(np.concatenate(impact))})

    return _best(lists.mapInArrow(first, "term int, row long, impact int"), "term", "impact", k, "row").select("term", "row")


def reached(lists: DataFrame, shared, thresholds) -> DataFrame:
    """Phase 2: (item, row, lower, upper) of every document with an entry at the threshold whose upper bound reaches tau."""

    def fetched(it):
        items, tau = shared.value, thresholds.value
        by_term: dict[int, list] = {}
        for item, terms in enumerate(items.terms):
            for t, f in zip(terms.tolist(), items.factors(item).tolist(), strict=True):
                if f:
                    least = -(-tau[item] // (len(terms) * f))  # entries below it are worth less than tau / m
                    by_term.setdefault(t, []).append((item, f, max(1, least)))
        for batch in it:
            out: list[tuple] = []
            for t, block, r, i in zip(*(batch[c].to_pylist() for c in ("term", "block", "rows", "impacts")), strict=True):
                row, impact = np.frombuffer(r, np.int64), np.frombuffer(i, np.int32).astype(np.int64)
                for item, factor, least in by_term.get(t, ()):
                    n = int(np.searchsorted(-impact, -least, "right"))
                    if n:
                        out.append((item, block, factor * (least - 1), row[:n].tobytes(), (factor * impact[:n]).tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["item", "block", "rest", "rows", "scores"])

    def bounded(it):
        items, tau = shared.value, thresholds.value
        at, held = None, []

        def made():
            item = at[0]
            of_item = items.factors(item)
            of_item = of_item[of_item > 0]
            most = int(sum(f * (max(1, -(-tau[item] // (len(items.terms[item]) * f))) - 1) for f in of_item.tolist()))  # if no list had shown it
            rows = np.concatenate([np.frombuffer(x[1], np.int64) for x in held])
            scores = np.concatenate([np.frombuffer(x[2], np.int64) for x in held])
            rest = np.repeat([x[0] for x in held], [len(x[1]) // 8 for x in held])
            row, of = np.unique(rows, return_inverse=True)
            lower, seen = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            np.add.at(lower, of, scores)
            np.add.at(seen, of, rest)
            upper = lower + most - seen
            ok = upper >= tau[item]
            return pa.record_batch({"item": pa.array(np.full(int(ok.sum()), item, np.int32)), "row": pa.array(row[ok]), "lower": pa.array(lower[ok]), "upper": pa.array(upper[ok])})

        for batch in it:
            for item, block, rest, r, s in zip(*(batch[c].to_pylist() for c in ("item", "block", "rest", "rows", "scores")), strict=True):
                if (item, block) != at:
                    if held:
                        yield made()
                    at, held = (item, block), []
                held.append((rest, r, s))
        if held:
            yield made()

    entries = lists.mapInArrow(fetched, "item int, block long, rest long, rows binary, scores binary")
    return entries.repartition("item", "block").sortWithinPartitions("item", "block").mapInArrow(bounded, "item int, row long, lower long, upper long")


def _kth(scored: DataFrame, value: str, k: int) -> dict[int, int]:
    """The k-th highest value of each item that has so many: one number an item of the block."""
    return {item: v for item, v in _best(scored.select("item", value), "item", value, k).where(F.col("rank") == k).select("item", value).collect()}


def _search(docs: DataFrame, block: list[tuple], field: pa.DataType, k: int, per_block: int) -> DataFrame:
    spark = docs.sparkSession
    items = Items(block, field)
    rows = stored(forward(docs, items.vocabulary))
    documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    items.weigh(documents, document_frequencies(rows, len(items.vocabulary)))
    shared = spark.sparkContext.broadcast(items)
    lists = stored(posting_lists(rows, documents, total, per_block))

    terms = spark.createDataFrame([(i, t) for i, own in enumerate(items.terms) for t in own[items.factors(i) > 0].tolist()], "item int, term int")
    pairs = heads(lists, k).join(terms, "term").select("item", "row").distinct()
    known = _kth(exact(pairs, rows, shared, documents, total), "score", k)
    tau = [known.get(i, 0) for i in range(len(items.terms))]

    found = stored(reached(lists, shared, spark.sparkContext.broadcast(tau)))
    raised = _kth(found, "lower", k)
    least = spark.createDataFrame([(i, max(tau[i], raised.get(i, 0))) for i in range(len(tau))], "item int, least long")
    candidates = found.join(least, "item").where("upper >= least").select("item", "row")
    scored = exact(candidates, rows, shared, documents, total).where("score > 0")
    best = _best(scored, "item", "score", k, F.col("doc_id").asc_nulls_last(), "row")

    def named(it):
        for batch in it:
            yield pa.record_batch({"item_id": shared.value.ids.take(batch["item"]), "rank": batch["rank"], "doc_id": batch["doc_id"], "score": batch["score"]})

    return best.select("item", "rank", "doc_id", "score").mapInArrow(named, _schema(field))


def _schema(field: pa.DataType) -> str:
    return f"item_id {'string' if field == pa.string() else 'long'}, rank int, doc_id long, score long"


def lexical_search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, max_terms: int = MAX_TERMS, per_block: int = BLOCK) -> DataFrame:
    """The k best documents of each item: item_id (long, or string where it is one), rank, doc_id, score."""
    session(docs)
    text_ids = benchmark.schema["item_id"].dataType.simpleString() == "string"
    field = pa.string() if text_ids else pa.int64()
    items = stored(item_terms(benchmark.withColumn("item_id", F.col("item_id").cast("string" if text_ids else "long"))))
    size = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = 1 + size // max_terms
    out = None
    for b in range(blocks):  # one block unless the items have more than max_terms terms in all
        block = items.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).collect()
        if block:
            part = _search(docs, [tuple(r) for r in block], field, k, per_block)
            out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], _schema(field))
    return out
