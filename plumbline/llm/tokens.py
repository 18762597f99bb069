"""Sizes of texts in tokens of a public tokenizer, whose file's path is a parameter."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.hashing import by_value

#: Where a tokenizer lies unless another path is given; executors must find it there, too.
PATH = "/opt/tokenizers/byte_bpe_50k.json"


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens by a ``tokenizers`` (.json) or ``sentencepiece`` (.model) file; special tokens in a text are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    raise ValueError(f"{path}: neither .json nor .model")


def token_count(path: str = PATH):
    """A column function: the number of tokens of a text, 0 for null. The file is read once per task."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counted = token_counter(path)
        for texts in batches:
            yield pd.Series(counted(texts.fillna("").tolist()), dtype="int64")

    return count


by_value()
