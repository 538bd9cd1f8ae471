"""BPE encoding and decoding of whole texts."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_pair import Store, encoder, split_words, unpacked, word_store
from .common import as_bytes


def _digest_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _text_store(path)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column("text"):
                made = [m for m in map(words.__getitem__, split_words(text.as_py())) if m[0]]
                counts.append(sum(m[0] for m in made))
                ids.append(sha256(b" ".join([m[1] for m in made])).hexdigest())
                decoded.append(sha256(b" ".join([m[2] for m in made])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


@functools.cache
def _text_store(path: str) -> Store:
    tokenizer = encoder(path)

    def texts(ids: bytes) -> tuple[int, bytes, bytes]:
        numbers = unpacked(ids)
        return len(numbers), " ".join(map(str, numbers)).encode(), tokenizer.decode(numbers).encode()

    return word_store(tokenizer, texts)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing. A text that
    is one long word is merged in n log n steps. Repeated rows and ids give
    repeated rows; other columns are not read. No rows give no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), as_bytes(F.col(text_col)).alias("text"))
    return texts.mapInArrow(_digest_batches(path), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with an array<int> column of the ids of each whole text; null and empty texts get an empty array.

    A column of docs named ids_col is replaced. Repeated rows stay repeated; no rows give no rows.
    """

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        words = word_store(encoder(path), unpacked)
        return texts.map(lambda t: [i for w in split_words((t or "").encode()) for i in words[w]])

    return docs.withColumn(ids_col, ids_of(F.col(text_col)))


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the string of each id array; null and empty arrays give an empty string.

    A column of encoded named text_col is replaced. Repeated rows stay repeated; no rows give no rows.
    """

    @F.pandas_udf("string")
    def text_of(ids):
        tokenizer = encoder(path)
        return ids.map(lambda x: tokenizer.decode([] if x is None else list(x)))

    return encoded.withColumn(text_col, text_of(F.col(ids_col)))
