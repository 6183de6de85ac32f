"""Models and thresholds of op4 and op5 come from all rows (F12, F13); the chunk cache keeps its values over batches."""

import pytest
from pyspark.sql import functions as F

from retentio.llm import bpe, pii, quality
from retentio.llm.bpe_codec import Codec
from retentio.llm.queries import tokenizer


class _Seen(Exception):
    pass


def test_personal_data_is_learnt_from_every_document(spark, monkeypatch):
    def seen(rows):
        raise _Seen(rows.count())

    monkeypatch.setattr(pii, "cut_lineage", seen)
    n = 24_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("Write to anna@example.org today.").alias("text"))
    counts = []
    for part in (docs.limit(0), docs):
        with pytest.raises(_Seen) as told:
            pii.fit(part)
        counts.append(told.value.args[0])
    # as it is, masked and spoiled
    assert counts[1] - counts[0] == 3 * n


def test_quality_is_learnt_from_every_labelled_row(spark, monkeypatch):
    counts, isotonic = [], quality.isotonic
    monkeypatch.setattr(quality, "isotonic", lambda s, n, ones: (counts.append(int(n.sum())), isotonic(s, n, ones))[1])
    docs = spark.range(0, 260_000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    model = quality.fit(docs, labels, features=8)
    assert counts == [docs.where(quality.fold_of(F.col("doc_id")) != quality.HELD_OUT).count()] and counts[0] > 200_000
    assert len(model.knots) == len(model.values)


def test_chunk_values_outlive_generations_and_long_chunks_do_not():
    c = Codec(tokenizer("word_bpe_49k.json"))
    cache = bpe.Cache(limit=2_000)
    long = "x" * 60 + "é."
    batches = [["the cat's hat, a hat.", long], ["a HAT; the ΣIGMA σ... 12", "über | don't"], ["the end\x1cof it's", ""]] * 4
    for texts in batches:
        parts = [c.parts(t) for t in texts]
        view = c.learn(parts, cache, c.merger.merge, b"".join)
        for doc in parts:
            for chunks, _ in doc:
                for chunk in chunks:
                    assert view[chunk] == b"".join(c.merger.merge(c.find(chunk)))
    cache.turn()
    assert long not in cache and long not in cache.old
