"""BPE encoding and decoding of a text column with the merge rounds of ``bpe``."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame

from tallyloom.llm.bpe import load
from tallyloom.llm.common import map_batches, texts_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of every whole text, one row per input row. A null text counts as empty and has no ids.

    Special tokens written in a text become their ids. Other columns are not carried on. Nothing is shuffled: a task
    encodes its batches one after the other, about two million characters at a time.
    """

    def step(batch):
        ids = [i.tolist() for i in load(path).encode(texts_of(batch, text))]
        yield {key: batch.column(0), "ids": ids}

    source = docs.select(key, text)
    return map_batches(source, step, f"{_field(source, key)}, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, text): token strings of the ids joined by spaces, as the library gives for a vocabulary without decoder.

    Null ids decode to the empty text.
    """

    def step(batch):
        bpe = load(path)
        yield {key: batch.column(0), "text": [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]}

    source = encoded.select(key, "ids")
    return map_batches(source, step, f"{_field(source, key)}, text string")


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (UTF-8 of the decoded text).

    Encodes, decodes what it has encoded, and keeps only the digests, in one pass.
    """

    def step(batch):
        bpe = load(path)
        n, ids_hash, text_hash = [], [], []
        for ids in bpe.encode(texts_of(batch)):
            ids = ids.tolist()
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        yield {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

    return map_batches(
        docs.select("doc_id", "text"), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _field(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}"
