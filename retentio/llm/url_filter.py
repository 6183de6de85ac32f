"""URL filters: a sorted array of 64-bit digests is memory-mapped, probed by binary search and confirmed by full strings.

A rule (host, path, verdict) fits its host and all subdomains if the URL's
path starts with the rule's path; of the rules that fit, the longest wins.
The key of a rule is host + path. A URL's candidate keys are its host's
suffixes at label borders joined with prefixes of its path, and only suffixes
of as many labels and prefixes of as many characters as some rule has.

The list is a file: the xxhash64 digests of the keys in ascending order, the
places of the keys, their verdicts, then the keys themselves. It is built on
the cluster up to the sorted rows, which reach the driver only after a count
shows that they stay below ``MAX_BYTES``; the file lies in the shared folder,
Spark hands it to every executor (``addFile``) and each task maps it. All
candidates of an Arrow batch are searched at once; every digest that is found
is confirmed by the stored string, so a collision never decides.

A list beyond the bound takes another way to the same result: the distinct
candidate keys and the list are dealt by a hash of the key into parts small
enough for a task, where the same search runs over the part's own sorted array.

Defined results: host is what stands after the first ``://`` up to ``/``,
``?``, ``#`` or the end, A-Z lower-cased; path goes on up to ``?``, ``#`` or
the end; both are empty for null URLs and those without ``://``. No rule
fits an empty host. Without a fitting rule, ``rule`` is null and the verdict is
the list's default: a URL that no rule names is allowed. Of two fitting rules
of equal length the one with the longer host wins; where one rule is listed
with both verdicts, it blocks; rules with null or empty host or another
verdict are passed over, a null rule path is empty. Rows are independent: repeated rows and null ids stay as they are. An
empty table gives no rows, an empty list the default. Only the id and the URL
of the table are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from .common import small_batches

#: bytes of a list (or of one part of a longer one) that a task or the driver may hold
MAX_BYTES = 16 << 20
VERDICTS = ("allow", "block")
DEFAULT = "allow"
_ROW_BYTES = 17  # digest, place and verdict of a rule
_FOUND = "rule string, verdict string"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a URL column, empty strings where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return lower_ascii(raw), F.regexp_extract(after, "^[^?#]*", 0)


class DigestArray:
    """Sorted digests with the keys and verdicts behind them, over one buffer (a mapped file or bytes)."""

    def __init__(self, buffer: np.ndarray):
        n, shapes = (int(x) for x in buffer[:16].view("<u8"))
        at = 16
        self.shapes = buffer[at : at + 16 * shapes].view("<u8").reshape(-1, 2).tolist()
        at += 16 * shapes
        self.digests = buffer[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.places = buffer[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.verdicts = buffer[at : at + n]
        self.keys = buffer[at + n :]

    @staticmethod
    def build(rules: list[tuple[str, str, int]]) -> bytes:
        """The file's bytes of distinct rules (host, path, 1: block)."""
        rows = sorted((xxhash.xxh64_intdigest(k := (h + p).encode()), k, v) for h, p, v in rules)
        shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules})
        return b"".join([
            np.array([len(rows), len(shapes)], "<u8").tobytes(), np.array(shapes, "<u8").tobytes(),
            np.array([d for d, _, _ in rows], "<u8").tobytes(),
            np.cumsum([0] + [len(k) for _, k, _ in rows]).astype("<u8").tobytes(),
            np.array([v for _, _, v in rows], "u1").tobytes(), b"".join(k for _, k, _ in rows)])

    def find(self, keys: list[str]) -> Iterator[tuple[int, int]]:
        """(place in ``keys``, verdict) of the keys that are in the list."""
        if not len(self.digests) or not keys:
            return
        raw = [k.encode() for k in keys]
        probes = np.fromiter(map(xxhash.xxh64_intdigest, raw), "<u8", len(raw))
        at = np.searchsorted(self.digests, probes)
        same = self.digests[np.minimum(at, len(self.digests) - 1)] == probes
        for k in np.flatnonzero(same & (at < len(self.digests))).tolist():
            row = int(at[k])
            # keys of equal digest stand side by side
            while row < len(self.digests) and self.digests[row] == probes[k]:
                if self.keys[int(self.places[row]) : int(self.places[row + 1])].tobytes() == raw[k]:
                    yield k, int(self.verdicts[row])
                    break
                row += 1


def candidates(host: str, path: str, shapes: list[list[int]]) -> Iterator[tuple[str, str]]:
    """(host suffix, path prefix) of every shape (labels, characters) of the list that the URL can fill."""
    if not host:
        return
    labels = host.split(".")
    for n, size in shapes:
        if n <= len(labels) and size <= len(path):
            yield ".".join(labels[-n:]), path[:size]


def probe(array: DigestArray, hosts: list[str], paths: list[str], default: str = DEFAULT) -> tuple[list, list]:
    """Rule (None: none fits) and verdict of every URL."""
    owners, tried = [], []
    for k, (host, path) in enumerate(zip(hosts, paths)):
        for pair in candidates(host, path, array.shapes):
            owners.append(k)
            tried.append(pair)
    best: dict[int, tuple] = {}
    for at, verdict in array.find([h + p for h, p in tried]):
        h, p = tried[at]
        mine = (len(h) + len(p), len(h), h + p, verdict)
        if (k := owners[at]) not in best or mine > best[k]:
            best[k] = mine
    rules = [best[k][2] if k in best else None for k in range(len(hosts))]
    return rules, [VERDICTS[best[k][3]] if k in best else default for k in range(len(hosts))]


def _clean(rules: DataFrame) -> DataFrame:
    """Distinct rules: host, path, block (0 or 1)."""
    return (rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                         F.when(F.col("verdict").isin(*VERDICTS), (F.col("verdict") == "block").cast("int")).alias("block"))
            .where("host <> '' AND block IS NOT NULL").groupBy("host", "path").agg(F.max("block").alias("block")))


def _published(spark: SparkSession, data: bytes) -> str:
    """Write ``data`` into the shared folder and hand it to all executors; its name there."""
    name = f"urls-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(checkpoint_dir(spark), "lists", name))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(data)
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


_MAPPED: dict[str, DigestArray] = {}


def _mapped(name: str) -> DigestArray:
    """The list, mapped once per worker; a newer list replaces it."""
    if name not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[name] = DigestArray(np.memmap(SparkFiles.get(name), np.uint8, "r"))
    return _MAPPED[name]


def _by_file(split: DataFrame, name: str) -> DataFrame:
    @F.pandas_udf(_FOUND)
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        array = _mapped(name)
        for hosts, paths in batches:
            rules, verdicts = probe(array, hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": pd.Series(rules, dtype=object), "verdict": pd.Series(verdicts, dtype=object)})

    return split.withColumn("found", judged("host", "path")).select("page_id", "host", "path", "found.rule", "found.verdict")


def _by_parts(split: DataFrame, rules: DataFrame, max_bytes: int) -> DataFrame:
    """The way for lists beyond the bound: distinct candidate keys and the list meet in parts by a hash of the key."""
    # one row per shape: label counts and path lengths, a few thousand at most
    shapes = [list(r) for r in rules.select(F.size(F.split("host", "[.]")), F.length("path")).distinct().collect()]

    @F.pandas_udf("array<struct<host:string,path:string>>")
    def tried(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([[{"host": a, "path": b} for a, b in candidates(h, p, shapes)] for h, p in zip(hosts, paths)], dtype=object)

    urls = cut_lineage(split.select("host", "path").distinct().withColumn("c", F.explode(tried("host", "path")))
                       .select("host", "path", F.col("c.host").alias("h"), F.col("c.path").alias("p")))
    keys = cut_lineage(urls.select("h", "p").distinct())
    wide = F.sum(F.octet_length(F.concat("h", "p")) + _ROW_BYTES)
    total = max(keys.agg(wide).first()[0] or 0, rules.select(F.col("host").alias("h"), F.col("path").alias("p")).agg(wide).first()[0] or 0)
    parts = max(1, -(-2 * total // max_bytes))
    part = lambda h, p: F.pmod(F.xxhash64(F.concat(h, p)), F.lit(parts)).alias("part")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        array = DigestArray(np.frombuffer(DigestArray.build(list(zip(right["host"], right["path"], right["block"]))), np.uint8))
        hit = list(array.find((left["h"] + left["p"]).tolist()))
        out = left.iloc[[k for k, _ in hit]][["h", "p"]].copy()
        out["block"] = [v for _, v in hit]
        return out

    found = (keys.select("h", "p", part("h", "p")).groupBy("part")
             .cogroup(rules.select("host", "path", "block", part("host", "path")).groupBy("part"))
             .applyInPandas(search, "h string, p string, block int"))
    size = F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("nh"), F.concat("h", "p").alias("rule"), "block")
    best = urls.join(found, ["h", "p"]).groupBy("host", "path").agg(F.max(size).alias("best"))
    return split.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best.block") == 1, "block").when(F.col("best.block") == 0, "allow").otherwise(DEFAULT).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, max_bytes: int = MAX_BYTES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``rules`` has host, path and verdict (allow or block)."""
    spark = pages.sparkSession
    small_batches(spark)
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = cut_lineage(_clean(rules))
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + _ROW_BYTES)).first()[0] or 0
    if size > max_bytes:
        return _by_parts(split, rules, max_bytes)
    rows = [tuple(r) for r in rules.select("host", "path", "block").collect()]  # below the counted bound
    return _by_file(split, _published(spark, DigestArray.build(rows)))
