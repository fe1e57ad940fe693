"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind divide text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a vocabulary file, once for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; null and blank texts have none."""
    if not text or text.isspace():
        return 0
    return len(encoder(path).encode_ordinary(text))


def with_tokens(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The table's other columns and `n_tokens` in place of the text, which goes no further."""
    others = [c for c in df.columns if c not in (text, "n_tokens")]
    name = os.path.basename(path)
    df.sparkSession.sparkContext.addFile(path)  # the vocabulary comes to the executors with the job
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField("n_tokens", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([count_tokens(t.as_py(), SparkFiles.get(name)) for t in batch.column(0)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes], names=[*others, "n_tokens"])

    return df.select(text, *others).mapInArrow(run, schema)


def filled(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is neither null nor blank."""
    return df.where(F.col(text).rlike(r"(?U)\S"))
