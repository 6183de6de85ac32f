"""Packing in bounded memory (round 3, the pipeline's check)."""

import corpus_pipeline

from retentio.llm import packing
from retentio.llm.queries import tokenizer


def test_packing_in_little_memory_gives_the_same_rows(spark, monkeypatch):
    texts = ["one two three four " * k + "über-größe <|x|> 12" * (k % 3) for k in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = tokenizer("word_bpe_49k.json")
    want = packing.pack(docs, path).drop("sequence_id").collect()
    assert packing.pack(docs, path, cache_bytes=500, slice_chars=60).drop("sequence_id").collect() == want
    assert [(s.start, s.stop) for s in packing.slices(["aaa", "", "bb", "cccccccc", "d"], 4)] == [(0, 2), (2, 3), (3, 4), (4, 5)]
    seen = {}
    monkeypatch.setattr(packing, "pack", lambda *a, **k: seen.update(k))
    corpus_pipeline.pack(spark, docs, "")
    assert seen["cache_bytes"] <= packing.CACHE_BYTES // 4 and seen["slice_chars"] <= packing.SLICE_CHARS // 4
