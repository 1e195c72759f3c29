"""Language identification with a blended-spectrum string kernel.

A stretch of a text is the set of its byte n-grams of one to four bytes (A-Z lower-cased,
blended over lengths, hashed to FEATURES). The kernel of two stretches is the size of
their common set over the geometric mean of their sizes; that of two texts is its mean
over their stretches, so that a text of any length is scored whole and doesn't fill the cells. LANDMARKS labelled texts
give the Nyström map; one-versus-rest kernel ridge regression is solved on it, and
a batch is scored by two matrix products.

The fit uses PER_LANG labelled texts of each language at most (those of the lowest
hash of doc_id); whole texts are used in the fit and in scoring. Only the landmarks' rows come to the
driver; the sums that the regression needs are made in tasks.

Cases: null text or text without a letter is `und` with score 0; a null or absent
training label is left out; of rows that share a doc_id one is learnt from, that of the lowest hash of language and text; without any training text everything is `und`;
repeated rows are scored each; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, session, texts
from .words import _LOWER, U, batches, buffers

FEATURES, GRAMS = 1 << 13, (1, 2, 3, 4)
#: Bytes of a stretch of a text at most, far fewer than would fill FEATURES, and stretches that are held at a time.
STRETCH, PART = 1024, 1024
#: Training texts of each language, landmarks in all, and the ridge.
PER_LANG, LANDMARKS, RIDGE = 1000, 192, 1e-3
SHARPNESS = 6.0
#: Tasks of the fit: each gives the driver sums of LANDMARKS x (LANDMARKS + languages) numbers.
FIT_TASKS = 16

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def presence(column: pa.Array, stretch: int = STRETCH):
    """Parts of the column's stretches: (text of each stretch, stretches x FEATURES, 1 where an n-gram of that hash starts).

    A text is cut into as few stretches of about the same size as have `stretch` bytes at most; an n-gram belongs to
    the stretch in which it starts, so that none is lost. A part has some stretches at a time, to bound memory.
    """
    data, offsets = buffers(column)
    size = np.diff(offsets).astype(np.int64)
    n = np.maximum(-(-size // stretch), 1)
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = np.append(offsets[:-1][text] + k * size[text] // n[text], offsets[-1]).astype(np.int64)
    for at in range(0, len(text), PART):
        own = slice(at, min(at + PART, len(text)))
        low, high = start[own.start], start[own.stop]
        # the last n-grams of the part reach into what follows it in the text
        piece = _LOWER[data[low : min(high + max(GRAMS) - 1, len(data))]].astype(np.uint32)
        out = np.zeros((own.stop - at, FEATURES), np.uint8)
        bytes_of = np.diff(start[own.start : own.stop + 1])
        row = np.repeat(np.arange(len(out), dtype=np.int64) * FEATURES, bytes_of)
        end = np.repeat(offsets[1:][text[own]].astype(np.int64) - low, bytes_of)
        code = np.zeros(len(piece), np.uint32)
        for g in GRAMS:
            code = code[: len(piece) - g + 1] | piece[g - 1 :] << np.uint32(8 * (g - 1)) if len(piece) >= g else code[:0]
            hashed = (code.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(g * 0x632BE59BD9B4E019 % 2**64)) * U(0xD6E8FEB86659FD93) >> U(64 - 13)
            m = min(len(code), len(row))
            inside = np.arange(g, m + g) <= end[:m]
            out.reshape(-1)[row[:m][inside] + hashed[:m][inside].astype(np.int64)] = 1
        yield text[own], out


def unit(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) / np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float32), 1))[:, None]


def means(column: pa.Array, of=None, width: int = FEATURES) -> np.ndarray:
    """For each text the mean over its stretches of their unit rows, or of what the linear map `of` makes of them."""
    total, n = np.zeros((len(column), width), np.float32 if of is None else np.float64), np.zeros(len(column))
    for text, x in presence(column):
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        rows = unit(x) if of is None else of(unit(x))
        total[text[first]] += np.add.reduceat(rows, first, axis=0)
        n[text[first]] += np.diff(np.append(first, len(text)))
    return total / np.maximum(n, 1)[:, None].astype(total.dtype)


def has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = buffers(column)
    ascii_count = np.append(0, np.cumsum(_ASCII_LETTER[data]))
    out = ascii_count[offsets[1:]] > ascii_count[offsets[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # landmarks x FEATURES, means of unit rows
    weights: np.ndarray  # landmarks x langs

    def scores(self, column: pa.Array) -> np.ndarray:
        return means(column, lambda x: x @ self.landmarks.T @ self.weights, len(self.langs))


def whitener(marks: np.ndarray) -> np.ndarray:
    """The Nyström map of the landmarks, to be multiplied by kernels with them."""
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    return vectors[:, kept] / np.sqrt(values[kept])


def sums(units: np.ndarray, y: np.ndarray, weight: np.ndarray, marks: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    """What some training rows add to the regression: their Gram matrix, beside it their products with the targets."""
    phi = (units @ marks.T).astype(np.float64) @ whiten
    target = np.where(y[:, None] == np.arange(len(weight)), 1.0, -1.0)
    return (phi * weight[y][:, None]).T @ np.concatenate([phi, target], axis=1)


def _packed(row: np.ndarray) -> bytes:
    """Bits where all that is not zero is equal, as in texts of one stretch; else half floats of the row over its largest cell."""
    most = row.max()
    if ((row == 0) | (row == most)).all():
        return np.packbits(row > 0).tobytes()
    return np.float32(most).tobytes() + (row / most).astype(np.float16).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == FEATURES // 8:
        return unit(np.unpackbits(np.frombuffer(data, np.uint8))[None])[0]
    return np.frombuffer(data[4:], np.float16).astype(np.float32) * np.frombuffer(data[:4], np.float32)[0]


def chosen(docs: DataFrame, learn, per_lang: int) -> DataFrame:
    """(doc_id, lang, h) of the rows to learn from: of each language the per_lang lowest hashes of doc_id.

    Only ids under a threshold that some twice as many pass are ranked, so that no task ranks a language. A language with
    few ids keeps them all, however many rows share one.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct()
    counts = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("of_lang")))
    low = rows.join(counts, "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("of_lang") < 2 * per_lang + 64)
    ranked = Window.partitionBy("lang").orderBy("h", "doc_id")
    return low.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= per_lang).select("doc_id", "lang", "rank").distinct()


def fit(docs: DataFrame, learn, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model | None:
    """learn: condition on docs (doc_id, text, lang) of rows that may be learnt from."""
    spark = docs.sparkSession
    ids = cut(chosen(docs, learn, per_lang))
    langs = sorted(r.lang for r in ids.select("lang").distinct().collect())
    if not langs:
        return None
    texts_of = docs.where("lang is not null").join(F.broadcast(ids.groupBy("doc_id").agg(F.min("rank").alias("rank"))), "doc_id")
    one = texts_of.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("lang", "text").alias("h"), "lang", "text", "rank")).alias("r")).select("r.*")
    rows = cut(one.repartition(FIT_TASKS, "h"))

    def features(it):
        for batch in batches(it, "text", 1 << 20):
            yield pa.record_batch({"lang": batch["lang"], "h": batch["h"], "x": pa.array([_packed(r) for r in means(batch["text"])], pa.binary())})

    per = max(1, landmarks // len(langs))
    of_lang = Window.partitionBy("lang").orderBy("rank", "h")
    first = rows.withColumn("k", F.row_number().over(of_lang)).where(F.col("k") <= per)
    got = first.select("text", "lang", "h").mapInArrow(features, "lang string, h long, x binary").toPandas().sort_values(["lang", "h"])
    marks = np.stack([_unpacked(r) for r in got.x])
    whiten, place = whitener(marks), {v: i for i, v in enumerate(langs)}
    size = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    weight = np.array([1 / max(1, size.get(v, 0)) for v in langs])  # languages count alike
    shared = spark.sparkContext.broadcast((marks, whiten))

    def added(it):
        total = 0.0
        for batch in batches(it, "text", 1 << 20):
            y = np.array([place[v] for v in batch["lang"].to_pylist()])
            total = total + sums(means(batch["text"]), y, weight, *shared.value)
        if not isinstance(total, float):
            yield pa.record_batch({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = sorted(r.sums for r in rows.select("text", "lang").mapInArrow(added, "sums binary").collect())
    m = whiten.shape[1]
    total = np.sum([np.frombuffer(p).reshape(m, m + len(langs)) for p in parts], axis=0)
    return Model(langs, marks, (whiten @ np.linalg.solve(total[:, :m] + RIDGE * np.eye(m), total[:, m:])).astype(np.float32))


def language_id(docs: DataFrame, learn, held_out, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learn and held_out are conditions on doc_id."""
    spark = session(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(fit(docs, learn, per_lang))

    def rows(it):
        m = model.value
        for batch in batches(it, "text", 4 << 20):
            known = has_letter(batch["text"])
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if m is not None and known.any():
                s = SHARPNESS * m.scores(batch["text"])
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                names[known] = np.array(m.langs, object)[p.argmax(axis=1)[known]]
                score[known] = p.max(axis=1)[known]
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": pa.array(names, pa.string()), "score": pa.array(score)})

    return texts(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False))).mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")
