"""SimHash near-duplicates with BK-trees: fingerprints link at a Hamming distance of ``radius`` or less.

A fingerprint has a bit where over half of the XXH64 hashes of a text's word
shingles have it. Distinct fingerprints are dealt to shards that must hold
both ends of every link: the 64 bits are cut into ``radius + 1`` groups, two
fingerprints that differ in at most ``radius`` bits agree on a whole group, and
the leading bits of a group (as many as make shards of some thousand members,
more where a shard is larger, see ``steps``) are the shard's key. Within a
shard a BK-tree (children keyed by the integer Hamming distance to their
parent) is built and searched along the edges within the radius.

A shard's tree is searched by the shard's own members and by nobody else, so
tree and queries meet in one task by a shuffle of 8-byte numbers. A broadcast
would carry every tree to every executor and all fingerprints through the
driver, for which there is no size bound. A shard that still is too large
after all bits that links must share is cut into chunks; each ordered pair of
chunks is a task (tree of one, queries of the other). A task emits only a spanning forest of the links it finds.
Components are found by large-star/small-star rounds over these edges.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows of equal text always share a component; null ids count as the
largest id and are a component's name only where it has no other; ids may be of any type that can be
ordered; columns beside id and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_batches, text_or_empty

SHINGLE, RADIUS, SEED = 3, 2, 42
#: fingerprints of a shard, and queries that search a tree at once
SHARD, _QUERIES = 4096, 512
#: hashes whose bits are counted at once
_BLOCK = 1 << 14


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer; words are cut at ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k].tolist(), ends[k:].tolist())
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return hashed(text)


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it; built and searched level by level.

    ``items`` are distinct unsigned 64-bit numbers; the tree is the one that
    inserting them in this order gives. ``edges`` holds node * 65 + distance in
    ascending order, ``ends`` the child at each edge. ``visited`` counts the
    nodes that searches compared.
    """

    def __init__(self, items: np.ndarray):
        self.items, self.visited = items, 0
        codes, ends = [], []
        rest, owner = np.arange(1, len(items)), np.zeros(max(len(items) - 1, 0), np.int64)
        while len(rest):
            code = owner * 65 + np.bitwise_count(items[rest] ^ items[owner])
            # the first item at a distance becomes the child there, the others go on below it
            found, first, back = np.unique(code, return_index=True, return_inverse=True)
            child = rest[first]
            codes.append(found)
            ends.append(child)
            owner = child[back]
            below = rest != owner
            rest, owner = rest[below], owner[below]
        codes, ends = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (codes, ends))
        order = np.argsort(codes)
        self.edges, self.ends = codes[order], ends[order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query place, item place) of all items within the radius, following only the edges within it."""
        if not len(self.items):
            return
        for start in range(0, len(queries), _QUERIES):
            query = np.arange(start, min(start + _QUERIES, len(queries)))
            node = np.zeros(len(query), np.int64)
            while len(node):
                self.visited += len(node)
                far = np.bitwise_count(self.items[node] ^ queries[query]).astype(np.int64)
                near = far <= radius
                yield query[near], node[near]
                low = np.searchsorted(self.edges, node * 65 + np.maximum(far - radius, 0))
                n = np.searchsorted(self.edges, node * 65 + np.minimum(far + radius, 64), "right") - low
                # the edges low .. low + n of every node, one after the other
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                query, node = np.repeat(query, n), self.ends[np.repeat(low, n) + step]


def _forest(pairs) -> list[tuple[int, int]]:
    """(member, root) for every member of a component that is not its root, over one task's links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            up.setdefault(min(ra, rb), min(ra, rb))
    return [(x, r) for x in up if (r := root(x)) != x]


_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_links(trees: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[list[tuple[int, int]], int]:
    """Spanning forest of the links between ``trees`` and ``queries`` (None: among ``trees``), signed; nodes visited."""
    items = trees.view(np.uint64)
    tree = BKTree(items)
    asked = items if queries is None else queries.view(np.uint64)

    def found():
        for q, t in tree.within(asked, radius):
            if queries is None:
                q, t = q[q < t], t[q < t]
            yield from zip(asked.view(np.int64)[q].tolist(), trees[t].tolist())

    return _forest(found()), tree.visited


def _shard_tasks(radius: int):
    """Reads rows sorted by (shard, chunk pair, role) and handles one pair of chunks at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, ([], [])

        def close() -> list[tuple[int, int]]:
            if now is None:
                return []
            trees, queries = (np.concatenate(x) if x else np.empty(0, np.int64) for x in held)
            return shard_links(trees, None if now[-2] == now[-1] else queries, radius)[0]

        out: list[tuple[int, int]] = []
        for batch in batches:
            names = ["step", "path", "key", "ci", "cj"]
            cells, fps, role = batch[names].to_numpy(np.int64), batch["fp"].to_numpy(np.int64), batch["role"].to_numpy()
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (cell := tuple(cells[a].tolist())) != now:
                    out += close()
                    now, held = cell, ([], [])
                for k in (0, 1):
                    held[k].append(fps[a:b][role[a:b] == k])
            if out:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
                out = []
        if out := close():
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _groups(bits: list[int], n: int) -> list[list[int]]:
    return [bits[len(bits) * k // n : len(bits) * (k + 1) // n] for k in range(n)]


def steps(n: int, radius: int = RADIUS, shard: int = SHARD) -> list[list[int]]:
    """Masks of each step by path: the bits on which the members of a shard agree.

    The bits fall into radius + 1 groups; two fingerprints within the radius
    differ in at most ``radius`` of these, so they agree on a whole group and
    meet in the shard of any of its leading bits. The first step takes as many
    bits as make shards of about ``shard`` out of n; shards that are larger take more bits
    of their group, and when these are used up, bits of groups of the rest.
    """
    width = 64 // (radius + 1)
    first = max(0, min(width, math.ceil(math.log2(max(1, n / shard)))))
    mask = lambda bits: _signed(sum(1 << b for b in bits))
    groups = _groups(list(range(64)), radius + 1)
    # with no bits at all, one shard holds all
    out = [[0]] if not first else []
    out += [[mask(g[:w]) for g in groups] for w in sorted({*range(max(first, 4), width, 4), *([first] if first else []), width})]
    inner = [[(g, h) for h in _groups([b for b in range(64) if b not in g], radius + 1)] for g in groups]
    for w in range(4, min(len(h) for x in inner for _, h in x) + 1, 5):
        out.append([mask(g + h[:w]) for x in inner for g, h in x])
    return out


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): a spanning forest, per shard, of the links between distinct fingerprints (column ``fp``)."""
    masks = steps(fps.count(), radius, shard)
    at, ready = fps.select("fp", F.lit(0).alias("path")), []
    for k, now in enumerate(masks):
        split = len(now) // (len(masks[k - 1]) if k else 1)
        path = F.explode(F.array(*[F.col("path") * split + j for j in range(split)])) if split > 1 else F.col("path")
        dealt = at.select("fp", path.alias("path"))
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.get(F.array(*[F.lit(m).cast("long") for m in now]), F.col("path"))))
        sizes = dealt.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        sized = cut_lineage(dealt.join(sizes, ["path", "key"]).withColumn("step", F.lit(k)))
        large = sized.where(F.col("n") > shard)
        last = k == len(masks) - 1 or large.isEmpty()
        ready.append(sized if last else sized.where(F.col("n") <= shard))
        if last:
            break
        at = large.select("fp", "path")
    members = reduce(DataFrame.unionByName, ready)
    # what no bits can part any more is cut into chunks; each ordered pair of chunks is a task of its own
    parts = F.when(F.col("step") == len(masks) - 1, F.ceil(F.col("n") / shard).cast("int")).otherwise(1)
    tasks = (members.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .select("step", "path", "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
             .select("step", "path", "key", "fp", F.least("mine", "other").alias("ci"), F.greatest("mine", "other").alias("cj"),
                     (F.col("mine") > F.col("other")).cast("int").alias("role")))
    shards = ["step", "path", "key", "ci", "cj"]
    return (tasks.repartition(*shards).sortWithinPartitions(*shards, "role", "fp")
            .mapInPandas(_shard_tasks(radius), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node it reaches."""
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)


def _placed(docs: DataFrame, shingle: int, radius: int, shard: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Written rows of ``docs`` with fp in the place of their text, and fp -> root of all distinct fingerprints."""
    rows = cut_lineage(docs.withColumn("fp", fingerprint(F.col(text), shingle)).drop(text))
    fps = cut_lineage(rows.select("fp").distinct())
    found = components(links(fps, radius, shard))
    roots = cut_lineage(fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))
    return rows, roots


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    small_batches(docs.sparkSession)
    rows, roots = _placed(docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")), shingle, radius, shard, "text")
    # the ids of a fingerprint are reduced before they meet those of its component
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = cut_lineage(least.join(roots, "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(names, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (nulls last), then the first row of the table.

    Rows are told apart by their place in a written copy of the table, so
    repeated and null ids lose nothing.
    """
    small_batches(docs.sparkSession)
    held = cut_lineage(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")))
    told = held.select(F.col(f"row.`{doc_id}`").alias("doc_id"), text_or_empty(f"row.`{text}`").alias("text"), "at")
    rows, roots = _placed(told, shingle, radius, shard, "text")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("at").alias("at"))
    best = rows.select("fp", order.alias("mine")).groupBy("fp").agg(F.min("mine").alias("mine")).join(roots, "fp").groupBy("root").agg(F.min("mine").alias("best"))
    # rows that go: a narrow written list, broadcast where its size allows; the texts stay where they are
    stay = roots.join(best, "root").select("fp", F.col("best.at").alias("stays"))
    gone = cut_lineage(rows.join(stay, "fp").where("at <> stays").select("at"))
    return held.join(gone, "at", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
