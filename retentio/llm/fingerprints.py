"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
it grows with its document, sketches of parts merge by union, and likeness and
containment of very unequal documents can be estimated. The least hash is kept
in any case: a short document is never without a sketch, and a comparison is
held to the range that both sketches cover in full.

Defined results: null text counts as empty; a text without words has an empty
sketch, alike (1) to another empty one and unlike (0) to any other; a text of
fewer than five words is one shingle; equal texts have equal fingerprints.
ids are whole numbers (a text that is none counts as a null id);
``with_next`` orders by descending id, null ids last, rows of equal id by a hash of the text, then the text;
the last row's next is the first; a lone row is its own next; columns beside id and text are not read, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

SHINGLE, FRACTION = 5, 0.25
#: ranges of ids that are counted and listed; larger ones spill when they are sorted
MAX_CELLS = 8192
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def bound(fraction: float = FRACTION) -> int:
    """Hashes below this (signed) are kept."""
    return int(-(1 << 63) + fraction * (1 << 64))


def with_sketch(df: DataFrame, text: str, name: str, fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of column ``text``: sorted array<long>."""
    words = F.filter(F.split(F.col(text), WORD_BREAK, -1), lambda w: w != "")
    hashed = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_words") - shingle, F.lit(0))),
        # get() beyond the end is null, which the hash passes over
        lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(shingle)]))
    kept = F.filter("_hashes", lambda h: h < bound(fraction))
    sketch = (F.when(F.size("_words") == 0, F.array().cast("array<bigint>"))
              .when(F.size("_kept") == 0, F.array(F.array_min("_hashes")))
              .otherwise(F.array_sort(F.array_distinct("_kept"))))
    return (df.withColumn("_words", words).withColumn("_hashes", hashed).withColumn("_kept", kept)
            .withColumn(name, sketch).drop("_words", "_hashes", "_kept"))


def _covered(a: Column, fraction: float) -> Column:
    """The largest hash up to which a sketch is complete."""
    return F.when(F.get(a, F.lit(0)) < bound(fraction), F.lit(bound(fraction) - 1)).otherwise(F.get(a, F.lit(0)))


def _both(a: Column, b: Column, fraction: float) -> tuple[Column, Column]:
    top = F.least(_covered(a, fraction), _covered(b, fraction))
    return F.filter(a, lambda h: h <= top), F.filter(b, lambda h: h <= top)


def likeness(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    x, y = _both(a, b, fraction)
    return (F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double"))
            .otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of a's shingles that b has (1 for an empty a)."""
    x, y = _both(a, b, fraction)
    return (F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(b) == 0, F.lit(0.0))
            .otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.lit(1))))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts' shingles together (shingles across the seam aside)."""
    union = F.array_sort(F.array_union(a, b))
    return F.filter(union, lambda h: (h < bound(fraction)) | (h == F.array_min(union)))


def as_text(sketch: Column) -> Column:
    """Hashes as 16 hex digits each, joined without a break."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _ranges(docs: DataFrame, parts: int) -> tuple[list[int], list[int], list[int]]:
    """Bounds of fine slices of doc_id, and per slice its first cell and its number of cells; null ids are the last slice.

    Slices are counted quantiles of the ids, an id that fills several of them
    being a slice of its own. Neighbouring slices share a cell until it holds
    its share of the bytes; a slice of one id with more than that is parted by
    a hash of the text. Cells are numbered in the order of the rows.
    """
    wanted = min(4 * parts, MAX_CELLS)
    steps = [k / wanted for k in range(1, wanted)]
    top, low, marks = docs.agg(F.max("doc_id"), F.min("doc_id"), F.percentile_approx("doc_id", steps, 20 * wanted)).first()
    marks = sorted(marks or [])
    twice = {a for a, b in zip(marks, marks[1:]) if a == b}
    bounds = [] if top is None else sorted({*marks, *(b - 1 for b in twice if b > low), top})
    weight = F.sum(F.octet_length("text") + 64)
    # at most MAX_CELLS quantiles, so a few times as many rows
    size = {r["slice"]: r["w"] for r in docs.groupBy(_slice(bounds).alias("slice")).agg(weight.alias("w")).collect()}
    share = max(1, sum(size.values()) // wanted)
    first, count, cell, held = [0] * (len(bounds) + 1), [1] * (len(bounds) + 1), 0, 0
    for k in [*range(len(bounds) - 1, -1, -1), len(bounds)]:
        w = size.get(k, 0)
        alone = k == len(bounds) or bounds[k] in twice
        if held and (alone or held + w > share):
            cell, held = cell + 1, 0
        first[k] = cell
        if alone:
            count[k] = max(1, -(-w // share))
            cell += count[k]
        else:
            held += w
    return bounds, first, count


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<bigint>")


def _slice(bounds: list[int]) -> Column:
    """Number of bounds below doc_id, by binary search; their number for a null id."""
    n, listed = len(bounds), _longs(bounds)
    if not n:
        return F.lit(0)
    mid = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    narrowed = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), span(F.lit(0), F.lit(n - 1)), lambda a, _: F.when(
        F.get(listed, mid(a)) < F.col("doc_id"), span(F.least(mid(a) + 1, a["hi"]), a["hi"])).otherwise(span(a["lo"], mid(a))), lambda a: a["lo"])
    return F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(narrowed)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with next_text, the text of the row that follows.

    Rows are dealt to cells, ranges of the order of about equal bytes. Each
    cell also receives the first row of the cell that follows it, so the
    neighbour across the border is at hand and one shuffle of the texts does.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, first, count = _ranges(docs, parts)
    mark = F.xxhash64("text")
    share = lambda n: F.least(F.floor((mark.cast("double") / F.lit(2.0**64) + 0.5) * n), n - 1)
    sliced = docs.withColumn("slice", _slice(bounds).cast("int"))
    n = F.get(_longs(count), F.col("slice"))
    dealt = sliced.select("doc_id", "text", (F.get(_longs(first), F.col("slice")) + F.when(n > 1, share(n)).otherwise(0)).cast("long").alias("cell"))
    # at most a few times MAX_CELLS rows: the first row of each cell and the cell that gets it as well
    heads = dealt.groupBy("cell").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("down"), mark.alias("mark"))).alias("head")).collect()
    cells = sorted(r["cell"] for r in heads)
    before = {c: cells[k - 1] for k, c in enumerate(cells)}
    listed = spark.createDataFrame([(r["cell"], r["head"]["mark"], before[r["cell"]]) for r in heads], "cell long, mark long, also long")
    extra = (dealt.join(F.broadcast(listed), (listed["cell"] == dealt["cell"]) & (listed["mark"] == mark))
             # a row's mark only stands for the cell's first row together with the least order
             .select("also", "doc_id", "text").groupBy("also")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("down"), "text")).alias("head")))
    rows = dealt.withColumn("extra", F.lit(0)).unionByName(
        extra.select(F.bitwise_not("head.down").alias("doc_id"), F.col("head.text").alias("text"), F.col("also").alias("cell"), F.lit(1).alias("extra")))
    order = Window.partitionBy("cell").orderBy("extra", F.col("doc_id").desc_nulls_last(), mark, "text")
    return rows.repartition(parts, "cell").withColumn("next_text", F.lead("text").over(order)).where("extra = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, fraction: float = FRACTION, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likenesses to it and to the next document."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    n = F.length("text")
    swapped = F.floor(n / 3).cast("int")
    rows = with_next(source).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - swapped), F.substring("next_text", F.lit(1), swapped)))
    for name in ("text", "edited", "next_text"):
        rows = with_sketch(rows, name, f"{name}_sketch", fraction)
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("text_sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("text_sketch"), F.col("edited_sketch"), fraction).alias("near_edited"),
        likeness(F.col("text_sketch"), F.col("next_text_sketch"), fraction).alias("near_next"))
