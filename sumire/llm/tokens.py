"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import spread

#: Folder of the vocabulary files; any other may be given to token_counts.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_multi_50k.tiktoken"
_LOADED: dict = {}


def _pattern(folder: str) -> str:
    """The split pattern that the vocabulary's folder publishes."""
    spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def encoder(folder: str, name: str):
    """list of texts -> list of token counts; loaded once in each Python worker."""
    if (folder, name) not in _LOADED:
        path = os.path.join(folder, name)
        if name.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            own = tiktoken.Encoding("own", pat_str=_pattern(folder), mergeable_ranks=ranks, special_tokens={})
            _LOADED[folder, name] = lambda texts: [len(own.encode_ordinary(t)) for t in texts]
        elif name.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[folder, name] = lambda texts: [len(x) for x in own.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            _LOADED[folder, name] = lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[folder, name]


def _count(folder: str, name: str):
    def run(batches):
        count = encoder(folder, name)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(count(texts), pa.int64())], names=["id", "source", "tokens"])

    return run


def token_counts(documents: DataFrame, key: str = "doc_id", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(id, source, tokens) of every document; null and empty texts have 0 tokens."""
    rows = spread(documents.select(F.col(key).cast("long").alias("id"), F.col("source").cast("string").alias("source"), "text"))
    return rows.mapInArrow(_count(folder, name), "id long, source string, tokens long")
