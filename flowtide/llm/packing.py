"""Packing along a space-filling curve.

A document's vector of hashed words (whole words, that document's alone) is projected to four dimensions; their Hilbert
key orders the corpus by range, ties by doc_id, so that a group of equal keys is split
like any other. Each range is tokenised in order and laid into sequences of 1024
tokens, cut wherever a sequence is full. The last tokens of a range are cut into
sequences of powers of two: no sequence needs padding.

Cases: null text is empty and has the closing id 0 alone; repeated rows are
packed each; a document of any length is cut into as many pieces as it needs; an
empty table gives no pieces.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, session, texts
from .words import U, batches, split

LENGTH = 1024
END = 0
#: tiktoken's pattern overflows its stack on runs of white space of some 1,000,000 characters; texts with a run
#: of so many go to `tokenizers`, which gives the same ids in more time.
SPACE_RUN = 200_000
#: Dimensions and bits of each.
DIMS, BITS = 4, 12

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projections(column: pa.Array) -> np.ndarray:
    """Means of pseudo-random signs of each text's words, as whole numbers of [0, 2**BITS): they depend on that text alone."""
    words = split(column)
    counts = words.counts()
    out = np.zeros((len(counts), DIMS))
    signs = np.unpackbits((words.hashes() & U((1 << DIMS) - 1)).astype(np.uint8)[:, None], axis=1, bitorder="little")[:, :DIMS]
    have = counts > 0
    sums = np.add.reduceat(np.append(signs, np.zeros((1, DIMS), np.uint8), axis=0), words.first[:-1], axis=0, dtype=np.int64) if len(counts) else out
    out[have] = (2 * sums[have] - counts[have, None]) / counts[have, None]
    return np.clip(((np.tanh(3 * out) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with `bits` bits a dimension (rows of x), after Skilling's transposition."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    m = 1 << (bits - 1)
    q = m
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = m
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def encoder(ranks_path: str, pattern: str, special: dict[str, int]):
    """Ids of a text as the byte-level tokenizer of the same vocabulary gives them, special strings by their own ids."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    names = tuple(special)
    return lambda text: own.encode(text, allowed_special="all") if any(x in text for x in names) else own.encode_ordinary(text)


def long_space(text: str, run: int = SPACE_RUN) -> bool:
    """Whether some run of white space has `run` characters or more."""
    return len(text) >= run and any(m.end() - m.start() >= run for m in re.finditer(r"\s+", text))


def default_encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    fast = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    whole = functools.cache(lambda: Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return lambda text: whole().encode(text, add_special_tokens=False).ids if long_space(text) else fast(text)


class Layout:
    """Lays the ids of documents into sequences of `length`."""

    def __init__(self, base: int, length: int):
        self.base, self.length, self.sequence, self.used = base, length, 0, 0
        self.open: list[tuple] = []  # pieces of the last, unfinished sequence, with their ids
        self.done: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.length - self.used)
            self.open.append((doc, at, ids[at : at + n], len(ids)))
            self.used += n
            at += n
            if self.used == self.length:
                self._close(self.open, self.length)
                self.open, self.used = [], 0

    def _close(self, pieces: list[tuple], size: int) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids), total, self.base + self.sequence, offset))
            offset += len(ids)
        assert offset == size
        self.sequence += 1

    def finish(self) -> None:
        """Cuts the rest into sequences of powers of two."""
        rest, left = self.open, self.used
        for bit in range(left.bit_length() - 1, -1, -1):
            if not left >> bit & 1:
                continue
            room, now = 1 << bit, []
            while room:
                doc, start, ids, total = rest.pop(0)
                now.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._close(now, 1 << bit)
        self.open, self.used = [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.done, strict=True)) or [[]] * 7
        self.done = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def with_keys(docs: DataFrame) -> DataFrame:
    def rows(it):
        for batch in batches(it, "text"):
            yield pa.record_batch({"key": pa.array(hilbert(projections(batch["text"]))), "doc_id": batch["doc_id"], "text": batch["text"].cast(pa.string())})

    return docs.mapInArrow(rows, "key long, doc_id long, text string")


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, make_encoder=default_encoder, ranges: int | None = None) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = session(docs)
    ordered = with_keys(texts(docs)).repartitionByRange(ranges or partitions(spark), "key", "doc_id").sortWithinPartitions("key", "doc_id")

    def rows(it):
        from pyspark import TaskContext

        encode, layout = make_encoder(), Layout(TaskContext.get().partitionId() << 40, length)
        last = (None, None)
        for batch in it:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = text or ""
                if text != last[0]:  # exact copies have one key and stand together
                    last = (text, np.array([*encode(text), end], np.uint32))
                layout.add(doc, last[1])
            yield layout.take()
        layout.finish()
        yield layout.take()

    return ordered.select("doc_id", "text").mapInArrow(rows, PIECE)
