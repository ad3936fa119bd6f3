"""Token counts of whole texts by overlap resynchronisation (operator 9)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import encoder
from .common import bounded_batches

def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 16, overlap: int = 256) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Longer texts are encoded in chunks of `chunk` characters that overlap by `overlap` and are spliced where both
    neighbours prove a stable boundary; overlaps double until there is one (bpe.py).
    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows stay repeated; an
    empty table gives an empty result; other columns are not read. No shuffle: one pass over the scan.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        count = encoder(tokenizer, chunk=chunk, overlap=overlap).count
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
