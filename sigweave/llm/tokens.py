"""Token counts of documents by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import shipped
from .sentences import cue_spans

#: Fixed value: how the vocabulary's tokenizer parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Vocabulary file used where none is given; every executor reads it there.
VOCABULARY = os.environ.get("SIGWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, loss: bool = True) -> DataFrame:
    """keep, n_tokens (whole text), loss_tokens (of the cues' text lines; NULL unless loss).

    NULL and empty texts have 0 tokens. The vocabulary file must be readable by every executor; it is loaded once a
    worker. Texts never leave their task: only numbers go on.
    """
    schema = pa.schema([("n_tokens", pa.int64()), ("loss_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            n, l = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                k = len(encode(t)) if t else 0
                n.append(k)
                l.append(min(k, len(encode("".join([t[x:y] for x, y in cue_spans(t)])))) if loss and t else 0 if loss else None)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, schema[0].type), pa.array(l, schema[1].type)], names=[*keep, "n_tokens", "loss_tokens"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    ddl = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens bigint, loss_tokens bigint"
    return shipped(docs.select(*keep, F.col("text").alias("_text"))).mapInArrow(count, ddl)
