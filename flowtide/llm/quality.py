"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Every bucket of hashed words has a sparse ternary index vector. A word's context
vector is the sum of the index vectors of its neighbours in the training texts;
index and context vector together are the word's vector. A document is the mean
of its words' vectors and of its word shapes' vectors (runs of lower case, upper
case, digits, other letters and each mark), and the share of words that repeat
the word before. A network with one hidden layer gives a logit, divided by a
temperature that is fitted on training rows which the network hasn't seen.

The fit uses TRAIN labelled rows at most (those of the lowest hash of doc_id);
whole texts are used in the fit and in scoring.

Cases: null text is empty; empty texts get the network's score for a zero vector;
null labels are left out, and so is a doc_id with both labels; of texts that share a doc_id the one of the lowest hash is learnt from; with no labels or with one class, the score is the
share of that class (0.5 without any); repeated rows are scored each; empty
tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session, texts
from .words import U, Words, batches, inner_starts, split

#: Rows of the fit, buckets of words and of shapes, dimensions, neighbours on each side, and hidden units.
TRAIN, WORDS, SHAPES, DIMS, REACH, HIDDEN = 6000, 1 << 13, 1 << 11, 32, 2, 24

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x30:0x3A] = 1
_CLASS[0x61:0x7B] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x80:] = 2


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: two components +1, two -1."""
    r = np.random.default_rng(seed)
    out = np.zeros((n, DIMS), np.float32)
    at = np.argsort(r.random((n, DIMS)), axis=1)
    np.put_along_axis(out, at[:, :2], 1, axis=1)
    np.put_along_axis(out, at[:, 2:4], -1, axis=1)
    return out


def shapes(w: Words) -> np.ndarray:
    """A hash of the runs of byte classes in each word."""
    kind = _CLASS[w.data]
    first = np.zeros(len(kind) + 1, bool)
    first[w.start] = True
    kept = first[:-1]
    kept[1:] |= kind[1:] != kind[:-1]
    at = np.append(0, np.cumsum(kept))
    return Words(kind[kept], at[w.start], at[w.end], w.first).hashes()


@dataclass
class Tokens:
    word: np.ndarray
    shape: np.ndarray
    again: np.ndarray
    words: Words


def tokens(column: pa.Array) -> Tokens:
    w = split(column)
    h = w.hashes()
    again = np.zeros(len(h), np.float32)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & inner_starts(w, 2)[:-1]
    return Tokens((h & U(WORDS - 1)).astype(np.int64), (shapes(w) & U(SHAPES - 1)).astype(np.int64), again, w)


def pooled(t: Tokens, word_vectors: np.ndarray, shape_vectors: np.ndarray) -> np.ndarray:
    """Mean vectors of each text, and the share of repeating words."""
    n = t.words.counts()
    out = np.zeros((len(n), 2 * DIMS + 1), np.float32)
    if not len(t.word):
        return out
    have = np.flatnonzero(n)
    first = t.words.first[:-1][have]
    for lo, hi, values in ((0, DIMS, (word_vectors, t.word)), (DIMS, 2 * DIMS, (shape_vectors, t.shape))):
        out[have, lo:hi] = np.add.reduceat(values[0][values[1]], first, axis=0)
    out[have, 2 * DIMS] = np.add.reduceat(t.again, first)
    out[have] /= n[have, None]
    return out


@dataclass
class Model:
    word_vectors: np.ndarray
    shape_vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.center) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, column: pa.Array) -> np.ndarray:
        z = self.logits(pooled(tokens(column), self.word_vectors, self.shape_vectors)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Constant:
    share: float

    def score(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), self.share)


def _network(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4):
    """Two layers under Adam, batches of 128."""
    r = np.random.default_rng(7)
    p = [r.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = r.permutation(len(x))
        for at in range(0, len(x), 128):
            own = order[at : at + 128]
            a = x[own]
            h = np.maximum(a @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[own]) / len(own)
            back = np.outer(g, p[2]) * (h > 0)
            step += 1
            for i, grad in enumerate((a.T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], g.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return p


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, out of a fine geometric grid."""
    grid = np.geomspace(0.25, 8, 71)
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", train: int = TRAIN):
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(learn & F.col("y").isin(0, 1))
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train).collect()
    if len({r.y for r in chosen}) < 2:
        return Constant(float(np.mean([r.y for r in chosen])) if chosen else 0.5)
    texts_of = docs.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, y int")), "doc_id")
    one = texts_of.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    rows = cut(one.select("doc_id", "r.text", "y"))
    word_index, shape_index = index_vectors(WORDS, 11), index_vectors(SHAPES, 13)

    def contexts(it):
        """Sums over the partition of the neighbours' index vectors, for each bucket."""
        sums = np.zeros((WORDS, DIMS), np.float64)
        for batch in batches(it, "text", 2 << 20):
            t = tokens(batch["text"])
            if not len(t.word):
                continue
            near = np.zeros((len(t.word), DIMS), np.float32)
            for j in range(1, REACH + 1):
                if len(t.word) > j:
                    ok = inner_starts(t.words, j + 1)[: len(t.word) - j, None]
                    near[:-j] += word_index[t.word[j:]] * ok
                    near[j:] += word_index[t.word[:-j]] * ok
            order = np.argsort(t.word, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(t.word[order]) > 0))
            sums[t.word[order][first]] += np.add.reduceat(near[order], first, axis=0)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.record_batch({"i": pa.array(used), "v": pa.array([x.tobytes() for x in sums[used]], pa.binary())})

    context = np.zeros((WORDS, DIMS))

    def added(key, table):
        total = np.sum([np.frombuffer(v, np.float64) for v in table["v"].to_pylist()], axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    for i, v in rows.select("text").mapInArrow(contexts, "i long, v binary").groupBy("i").applyInArrow(added, "i long, v binary").collect():
        context[i] = np.frombuffer(v, np.float64)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    word_vectors = (word_index / 2 + np.divide(context, norm, out=np.zeros_like(context), where=norm > 0)).astype(np.float32)

    def features(it):
        for batch in batches(it, "text", 2 << 20):
            x = pooled(tokens(batch["text"]), word_vectors, shape_index)
            yield pa.record_batch({"doc_id": batch["doc_id"], "y": batch["y"], "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = rows.mapInArrow(features, "doc_id long, y int, x binary").toPandas().sort_values(["doc_id", "x"])
    if got.y.nunique() < 2:
        return Constant(float(got.y.mean()) if len(got) else 0.5)
    x = np.frombuffer(b"".join(got.x), np.float32).reshape(len(got), -1).astype(np.float64)
    y = got.y.to_numpy(np.float64)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - center) / scale
    r = np.random.default_rng(3).random(len(z)) < 0.2  # for the temperature only
    if len(set(y[r])) < 2 or len(set(y[~r])) < 2:
        r[:] = False
    w1, b1, w2, b2 = _network(z[~r], y[~r])
    model = Model(word_vectors, shape_index, center.astype(np.float32), scale.astype(np.float32), w1.astype(np.float32), b1.astype(np.float32), w2.astype(np.float32), float(b2[0]), 1.0)
    if r.any():
        model.temperature = _temperature(model.logits(x[r].astype(np.float32)), y[r])
    return model


def quality(docs: DataFrame, labels: DataFrame, learn, held_out, label: str = "quality", train: int = TRAIN, carry: str | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (and the binary column `carry`) of every row; learn and held_out are conditions on doc_id."""
    spark = session(docs)
    carried = (carry,) if carry else ()
    docs = texts(docs, carry=carried)
    model = spark.sparkContext.broadcast(fit(docs, labels, learn, label, train))

    def rows(it):
        for batch in batches(it, "text", 4 << 20):
            score = model.value.score(batch["text"])
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(score.astype(np.float64)), "predicted": pa.array((score >= 0.5).astype(np.int32))} | {c: batch[c] for c in carried})

    return docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))).mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int" + "".join(f", {c} binary" for c in carried))
