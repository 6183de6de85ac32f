"""Target-distribution importance resampling over hashed features, with CRCs computed in matrices by length.

Features of a text are its runs of 1 to ``max_run`` consecutive words, joined
by one space, repeats counted; a feature's bucket is the CRC-32 of its UTF-8
bytes modulo the number of buckets. The distinct features of an Arrow batch
are grouped by byte length into two-dimensional uint8 arrays; all CRCs of an
array are updated column by column, and the buckets are scattered back to the
places of the features. (A feature beyond ``LONG`` bytes is a matrix of one
row and thousands of columns; zlib computes the same CRC for it.)

The corpus is read once: each document becomes its sorted bucket numbers in a
written table. Bucket counts are summed per partition before they are
shuffled, so a corpus of any size gives as many rows as there are buckets,
and the gains, an array of that fixed length, travel with the tasks. A
bucket's gain compares its smoothed share in the target with that in the
corpus; a document's weight is the floored mean gain of its features. Gumbel
noise from a hash of the id is added, and the documents of the highest scores
are drawn, which samples without replacement in proportion to the weights.
Ranks come from a range-partitioned order with counted offsets.

Defined results: null text has no features (weight 0); words are runs of
digits, letters and non-ASCII characters, A-Z lower-cased; documents with fewer than
``least_words`` words are never drawn and do not count for the number drawn;
ties of the score go to the smaller doc_id (nulls last, their hash is that of
the empty string), then to the smaller digest of the text; repeated rows are documents of their own; an empty target
or corpus counts zero everywhere; an empty table gives no rows. Only id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import global_row_number
from ..session import cut_lineage
from .common import small_batches, text_or_empty

MAX_RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: bytes beyond which one feature alone would need thousands of column steps
LONG = 1024
#: bytes of features that are hashed at once
_BLOCK = 32 << 20
#: bytes of lower-cased UTF-8 outside 00-2F, 3A-60 and 7B-7F
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def crc_table() -> np.ndarray:
    """CRC-32 of every byte value (reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = crc_table()


def crc32_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a uint8 matrix, one column after the other."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def crc32_all(features: list[bytes]) -> np.ndarray:
    """CRC-32 of every feature, through one matrix per byte length."""
    out = np.empty(len(features), np.uint32)
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        size = int(sizes[places[0]])
        if size > LONG:
            out[places] = [zlib.crc32(features[k]) for k in places]
            continue
        step = max(1, _BLOCK // max(1, size))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            matrix = np.frombuffer(b"".join([features[k] for k in some.tolist()]), np.uint8).reshape(len(some), size)
            out[some] = crc32_matrix(matrix)
    return out


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8").lower())


def features(tokens: list[bytes], max_run: int = MAX_RUN) -> list[bytes]:
    """All runs of 1 to ``max_run`` consecutive words."""
    out = list(tokens)
    for n in range(2, max_run + 1):
        out += [b" ".join(tokens[k : k + n]) for k in range(len(tokens) - n + 1)]
    return out


def with_buckets(docs: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """Adds n_words, n_features and buckets (sorted numbers, little-endian unsigned 32-bit, as binary)."""

    @F.pandas_udf("n_words long, n_features long, buckets binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            tokens = [words(t) for t in texts]
            runs = [features(w, max_run) for w in tokens]
            distinct = list({f for run in runs for f in run})
            bucket = dict(zip(distinct, (crc32_all(distinct) % np.uint32(buckets)).tolist()))
            cells = [np.sort(np.fromiter((bucket[f] for f in run), "<u4", len(run))).tobytes() for run in runs]
            yield pd.DataFrame({"n_words": [len(w) for w in tokens], "n_features": [len(r) for r in runs], "buckets": cells})

    found = docs.withColumn("_found", hashed(text_or_empty(text)))
    return found.select(*docs.columns, "_found.n_words", "_found.n_features", "_found.buckets")


def bucket_counts(hashed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs (column ``buckets``); partitions are summed before the shuffle."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch["buckets"]:
                total += np.bincount(np.frombuffer(cell, "<u4"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype(np.int64), "n": total[some]})

    rows = (hashed.select("buckets").mapInPandas(summed, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # one row per bucket at most
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, per bucket."""
    k = float(len(corpus))
    top = (target.astype(float) + 1.0) * (float(corpus.sum()) + k)
    low = (corpus.astype(float) + 1.0) * (float(target.sum()) + k)
    return np.floor(1000.0 * np.log(top / low)).astype(np.int64)


def with_weights(hashed: DataFrame, gain: np.ndarray) -> DataFrame:
    """Adds weight: the floored mean gain of a document's features, 0 without any."""

    @F.pandas_udf("long")
    def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for cells in batches:
            out = []
            for cell in cells:
                at = np.frombuffer(cell, "<u4")
                out.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            yield pd.Series(out, dtype="int64")

    return hashed.withColumn("weight", weight("buckets"))


def noise(doc_id: str, seed: int = SEED):
    """Gumbel noise in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    share = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(share))).cast("long")


def resample(docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null: not drawn)."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.md5(text_or_empty(text).cast("binary")).alias("digest"))
    hashed = cut_lineage(with_buckets(source, max_run, buckets).drop("text"))
    wanted = with_buckets(target.select(F.col(text).alias("text")), max_run, buckets)
    gain = gains(bucket_counts(hashed, buckets), bucket_counts(wanted, buckets))
    scored = (with_weights(hashed, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
              .select("doc_id", "n_features", "weight", "score", "digest", (F.col("n_words") >= least_words).alias("fit")))
    scored = cut_lineage(scored)
    drawn = scored.where("fit").count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*out)
    # only rows down to the least score that can be drawn are ordered
    reach = F.col("fit") & (F.col("score") >= F.lit(_least_score(scored.where("fit"), drawn)))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("digest").asc()]
    ranked = global_row_number(scored.where(reach), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.select(*out).unionByName(scored.where(~reach).withColumn("rank", F.lit(None).cast("long")).select(*out))


def _least_score(scored: DataFrame, drawn: int) -> int:
    """The highest score that still has ``drawn`` documents at or above it.

    Scores are whole thousandths of bounded logarithms (gains: ln of at most the corpus size, noise: -3.1 to 22.9),
    so the counts per score that reach the driver are some ten thousand rows at any size of the corpus.
    """
    counts = sorted(((r["score"], r["count"]) for r in scored.groupBy("score").count().collect()), reverse=True)
    at = np.searchsorted(np.cumsum([n for _, n in counts]), drawn)
    return counts[int(at)][0]
