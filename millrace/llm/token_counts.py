"""Operator 4: token counts of whole texts, huge ones by overlapping chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe
from .common import per_batch

#: Characters from which a text is huge: it is encoded in overlapping chunks of half that size.
HUGE = 65_536


def token_counts(docs: DataFrame, path: str, limit: int = 512, huge: int = HUGE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    Counts are those of the tokenizer library on the whole text, without added
    tokens. A null or empty text has none. Rows that repeat are counted each;
    columns other than doc_id and text are ignored.
    """
    slim = docs.select("doc_id", "text")
    kind = T.StructType([slim.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "")
        large = pc.greater(pc.utf8_length(texts), huge).to_numpy(zero_copy_only=False)
        n = bpe.counts_of(path, pc.if_else(pa.array(large), "", texts))
        for i in np.flatnonzero(large):
            n[i] = bpe.spliced_count(path, texts[int(i)].as_py(), huge // 2)
        return pa.record_batch([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(per_batch(count), kind)
