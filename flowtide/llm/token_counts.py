"""Token counts of whole texts: Arrow functions that return lengths only.

Batches are balanced by bytes. A long text is split where the count can't change:
at a single space between two characters that are not spaces. The model marks
every such space by one symbol that no learned piece holds except at its front,
and a part's own start gets the same symbol, so the parts' pieces are the text's.

Cases: null text is empty and has no tokens; a long text without such a space is
encoded whole; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import session, texts
from .words import batches, buffers

#: Bytes of texts encoded at once, characters from which a text is split, and tokens over which a text is marked.
BATCH_BYTES, LONG, LIMIT = 2 << 20, 32_768, 4096

#: The white space symbol of the model counts as a space.
SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def parts(text: str, long: int = LONG) -> list[str]:
    """The text in pieces of about `long` characters, cut at safe spaces, which are left out."""
    out, at = [], 0
    while len(text) - at > long and (cut := SAFE.search(text, at + long)):
        out.append(text[at : cut.start()])
        at = cut.end()
    out.append(text[at:])
    return out


def default_counter():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return lambda many: [len(x) for x in model.encode(many, num_threads=1)]


def token_counts(docs: DataFrame, limit: int = LIMIT, make_counter=default_counter, long: int = LONG) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    session(docs)

    def rows(it):
        count = make_counter()
        for batch in batches(it, "text", BATCH_BYTES):
            each = [parts(x or "", long) for x in batch["text"].to_pylist()]
            counts = np.array(count([p for x in each for p in x]), np.int64)
            first = np.cumsum([0] + [len(x) for x in each])
            n = np.add.reduceat(counts, first[:-1])
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_bytes": pa.array(np.diff(buffers(batch["text"])[1])), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return texts(docs).mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
