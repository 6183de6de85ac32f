"""Packing by power-of-two decomposition: every piece is a sequence of its own, bucketed by length.

A document's ids (with an end id) are cut into blocks of ``max_len`` and the
binary digits of what is left, longest first. Each piece therefore has a
power-of-two length, fills one sequence without padding, and no sequence holds
two documents. ``write_buckets`` stores one folder per length, so a training
step draws equally long sequences. Nothing is shuffled: a piece's sequence id
comes from its place in the input's partitions, unique over the result. The
id is only stable for a stable input; write the result before reading it twice.

Defined results: a null or empty text is a document of one id (the end id);
repeated rows are packed once per row; ids of sequences never tie; an empty
table gives no rows; further columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Cache
from .bpe_codec import codec
from .common import small_batches, text_or_empty

MAX_LEN, END_ID = 4096, 2
#: a worker remembers the ids of words in two generations of at most so many bytes, and encodes so many characters at once
CACHE_BYTES, SLICE_CHARS = 80 << 20, 4 << 20
_END = np.array([END_ID], "<u4").tobytes()


def slices(texts: list[str], chars: int) -> Iterator[slice]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield slice(begin, k)
            begin, held = k, 0
        held += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def cut(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of n ids: blocks of max_len, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, path: str, max_len: int = MAX_LEN, with_ids: bool = False,
         doc_id: str = "doc_id", text: str = "text", cache_bytes: int = CACHE_BYTES, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids].

    ``max_len`` must be a power of two. ``with_ids`` adds the piece's ids
    (array<int>), which training reads; without it only their checksum stays.
    ``cache_bytes`` and ``slice_chars`` trade a worker's memory for time and never change a result.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        if c.raw.limit != cache_bytes:  # the worker may have served a job with another bound
            c.raw = Cache(limit=cache_bytes)

        def raw(ids: list[int]) -> bytes:
            return np.array(ids, "<u4").tobytes()

        for batch in batches:
            out = []
            texts = batch["body"].tolist()
            for run in slices(texts, slice_chars):
                parts = [c.parts(t) for t in texts[run]]
                view = c.learn(parts, c.raw, c.merger.merge, b"".join)
                for doc, runs in zip(batch["doc_id"].iloc[run], parts):
                    data = b"".join([b"".join(map(view.__getitem__, chunks)) + (raw([end]) if end >= 0 else b"") for chunks, end in runs] + [_END])
                    n = len(data) // 4
                    at = 0
                    for size in cut(n, max_len):
                        piece = data[4 * at : 4 * (at + size)]
                        row = (doc, at, size, zlib.crc32(piece), n)
                        out.append((*row, np.frombuffer(piece, "<u4").astype("int32")) if with_ids else row)
                        at += size
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids).astype({"doc_id": batch["doc_id"].dtype})

    if kind == "bigint":  # a null id must not turn the others into doubles
        source = docs.select(F.col(doc_id).cast("string").alias("doc_id"), text_or_empty(text).alias("body"))
        out = source.mapInPandas(pieces, schema.replace("doc_id bigint", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
    else:
        out = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body")).mapInPandas(pieces, schema)
    return out.withColumns({
        "sequence_id": F.monotonically_increasing_id(),
        "offset": F.lit(0).cast("long"),
        "bucket": F.log2(F.col("length").cast("double")).cast("int"),
    })


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per piece length; within it every sequence is equally long."""
    packed.write.mode("errorifexists").partitionBy("bucket").parquet(path)
