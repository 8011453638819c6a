"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, equal pieces of a group are encoded once, and batches for the
tokenizer are balanced by bytes, so a text of any length takes bounded memory beside itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffline.llm.common import groups, id_field

#: The sign that the tokenizer writes for a space.
SPACE_SIGN = "▁"
#: A single space with something else on either side.
SAFE = re.compile(f"(?<=[^ {SPACE_SIGN}]) (?=[^ {SPACE_SIGN}])")
BATCH_BYTES = 128 << 10
#: A worker forgets its pieces when they are more than this many, or have more characters than this.
CACHED_PIECES = 400_000
CACHED_CHARS = 1 << 24


def balanced(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about equal bytes; a longer piece is alone."""
    batch, held = [], 0
    for piece in pieces:
        size = len(piece.encode())
        if batch and held + size > limit:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += size
    if batch:
        yield batch


def cut(text: str) -> list[str]:
    """Pieces whose token counts add up to that of the text.

    The encoder puts its space sign before a text, as it does for the space that is cut away here, and
    no vocabulary entry has that sign after another character (``counter`` checks this).
    """
    if not text:
        return []
    if "  " in text or SPACE_SIGN in text or text[0] == " " or text[-1] == " ":
        return SAFE.split(text)
    return text.split(" ")


@lru_cache(maxsize=2)
def counter(model: str):
    """Function from pieces to their token counts; the model is loaded once in a worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    if any(SPACE_SIGN in sp.id_to_piece(i).lstrip(SPACE_SIGN) for i in range(sp.get_piece_size())):
        raise ValueError("this vocabulary joins words; texts can't be cut at spaces")
    known: dict[str, int] = {}
    held = 0

    def count(texts: list[str]) -> np.ndarray:
        nonlocal held
        pieces = [cut(t) for t in texts]
        if len(known) > CACHED_PIECES or held > CACHED_CHARS:
            known.clear()
            held = 0
        missing = list({p for ps in pieces for p in ps} - known.keys())
        held += sum(map(len, missing))
        for batch in balanced(missing):
            known.update(zip(batch, map(len, sp.encode(batch, num_threads=1))))
        get = known.__getitem__
        return np.array([sum(map(get, ps)) for ps in pieces], dtype=np.int64)

    return count


def token_counts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    A null text counts as empty: no bytes, no tokens. A null id and repeated rows are kept, each with its
    own row. Extra columns are ignored, whatever their names. An empty table gives an empty one.
    """
    rows = docs.select(id_col, text_col)
    schema = T.StructType([id_field(docs, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            counts = [np.zeros(0, np.int64)] + [count(texts) for _, texts in groups(batch, text_col)]
            sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes.cast(pa.int64()), pa.array(np.concatenate(counts))],
                names=[id_col, "n_bytes", "n_tokens"],
            )

    over: Column = F.col("n_tokens") > limit
    return rows.mapInArrow(run, schema).withColumn("over_limit", over)
