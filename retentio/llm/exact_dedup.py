"""Exact duplicates by a stateful stream: keyed state on disk, without expiry, and a check of full bytes on hits.

Each batch of documents becomes a log in the shared folder: digest of the
normalised text, identifier, length, content locator (batch and place in it)
and the content itself, which only the check and ``keep_first`` read. A
Structured Streaming aggregation keyed by digest reads the narrow columns; its
state lives in RocksDB on the executors' disks with checkpoints in the shared
folder, and there is no watermark, so a digest is never forgotten. The state
holds, per digest, the row that stays (most code points, then smallest id, then
first locator) and the group's size.

A batch is logged once: ``append`` with a number whose log is complete is a
replay and adds nothing (other rows under that number are an error), and the
stream goes on from its checkpoint, after a restart too. Later batches may
bring a better row for a group; ``verdicts`` always judges by the present state.

A hit (a digest of more than one row) is only a candidate: the full normalised
texts of hit digests, of whatever batch, are fetched by the log and grouped; a
digest under which two texts meet is a collision, and its rows are grouped by
the text itself instead.

Only DataFrame operations run on the executors. Ids may be of any type that
can be ordered, the same in all batches. Defined results: null text
counts as empty; all empty texts are one group; null ids come last among ties;
repeated rows (same id and text) are one group of which the first locator
stays, also where their ids are null; other columns are not carried by ``verdicts``, and ``keep_first`` keeps
them whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from .common import text_or_empty

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    # without it every state partition takes several MB of disk ahead of its data
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # a state partition leaves memory when its micro-batch is committed
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _better() -> Column:
    """Orders the rows of a group: the least is the one that stays."""
    return F.struct((-F.col("n_code")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "batch", "locator")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _sign(rows: DataFrame) -> tuple:
    """Tells whether two logs hold the same rows."""
    return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64(F.col("doc_id").cast("string"), "digest").cast("decimal(38,0)"))).first())


class Deduplicator:
    """Digest-keyed state in ``folder`` (a new folder under the shared checkpoint folder if none is given)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest=sha256):
        self.spark, self.digest = spark, digest
        self.folder = folder or os.path.join(checkpoint_dir(spark), "exact", uuid.uuid4().hex)
        self.log, self.out, self.state = (os.path.join(self.folder, n) for n in ("log", "groups", "state"))

    def append(self, docs: DataFrame, batch: int, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> None:
        """Log the documents of a batch, unless its log is there, and let the state catch up; ``keep`` logs all columns."""
        body = text_or_empty(text)
        rest = [F.col(f"`{c}`") for c in docs.columns if keep and c != text]
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.length(body).cast("long").alias("n_code"),
                           self.digest(normalised(body)).alias("digest"),
                           F.monotonically_increasing_id().alias("locator"), F.lit(batch).cast("long").alias("batch"),
                           F.col(text).cast("string").alias("body"), F.struct(*rest or [F.lit(0).alias("none")]).alias("rest"))
        at = os.path.join(self.log, f"batch={batch}")
        if not _exists(self.spark, os.path.join(at, "_SUCCESS")):
            rows.write.mode("overwrite").parquet(at)
        elif _sign(self.spark.read.parquet(at)) != _sign(rows):
            raise ValueError(f"batch {batch} is logged with other rows")
        id_type = docs.schema[doc_id].dataType.simpleString()
        narrow = f"doc_id {id_type}, n_code long, digest string, locator long, batch long"
        with _conf(self.spark, STATE_CONF):
            stream = (self.spark.readStream.schema(narrow).parquet(os.path.join(self.log, "batch=*"))
                      .groupBy("digest").agg(F.min(_better()).alias("best"), F.count("*").alias("n")))

            def store(groups: DataFrame, epoch: int) -> None:
                # keyed by epoch: a replayed micro-batch overwrites its own output
                groups.write.mode("overwrite").parquet(os.path.join(self.out, f"epoch={epoch}"))

            query = (stream.writeStream.outputMode("update").foreachBatch(store)
                     .option("checkpointLocation", self.state).trigger(availableNow=True).start())
            query.awaitTermination()

    def rows(self, batch: int | None = None) -> DataFrame:
        """The log: doc_id, n_code, digest, batch, locator and body (``rest`` too, of one batch)."""
        if batch is not None:
            return self.spark.read.parquet(os.path.join(self.log, f"batch={batch}"))
        return self.spark.read.parquet(os.path.join(self.log, "batch=*")).drop("rest")

    def groups(self) -> DataFrame:
        """The state as last written: one row per digest."""
        out = self.spark.read.parquet(self.out)
        last = out.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "epoch").alias("s"))
        return last.select("digest", "s.best", "s.n")

    def collided(self, groups: DataFrame) -> DataFrame:
        """Digests under which two different texts meet: the logged texts of hit digests are grouped byte by byte."""
        texts = self.rows().select("digest", normalised(text_or_empty("body")).alias("norm"))
        seen = texts.join(groups.where("n > 1").select("digest"), "digest", "left_semi")
        return (seen.groupBy("digest", "norm").agg(F.count("*").alias("n"))
                .groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"))

    def judged(self, batch: int | None = None) -> DataFrame:
        """Per logged row (of one batch, or all): doc_id, batch, locator, keep_id, group_size, kept, text_sha256."""
        groups = cut_lineage(self.groups())
        collided = cut_lineage(self.collided(groups))
        norm = normalised(text_or_empty("body"))

        def told(rows: DataFrame, sha: Column) -> DataFrame:
            mine = (F.col("best.locator") == F.col("locator")) & (F.col("best.batch") == F.col("batch"))
            return rows.select("doc_id", "batch", "locator", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                               mine.alias("kept"), sha.alias("text_sha256"))

        plain, sha = self.rows(batch), F.col("digest") if self.digest is sha256 else sha256(norm)
        if collided.isEmpty():
            return told(plain.join(groups, "digest"), sha)
        apart = self.rows().join(collided, "digest", "left_semi").withColumn("norm", norm)
        best = apart.groupBy("digest", "norm").agg(F.min(_better()).alias("best"), F.count("*").alias("n"))
        if batch is not None:
            apart = apart.where(F.col("batch") == batch)
        rest = plain.join(collided, "digest", "left_anti").join(groups, "digest")
        return told(rest, sha).unionByName(told(apart.join(best, ["digest", "norm"]), sha256(F.col("norm"))))


def verdicts(docs: DataFrame, folder: str | None = None, digest=sha256, doc_id: str = "doc_id", text: str = "text", batch: int = 0) -> DataFrame:
    """One row per document of the batch: doc_id, keep_id, group_size, kept, text_sha256, against all batches in ``folder``."""
    state = Deduplicator(docs.sparkSession, folder, digest)
    state.append(docs, batch, doc_id, text)
    return state.judged(batch).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame, digest=sha256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    state = Deduplicator(docs.sparkSession, None, digest)
    state.append(docs, 0, doc_id, text, keep=True)
    # a narrow written list, which the planner broadcasts where its size allows; the texts stay where they are
    gone = cut_lineage(state.judged(0).where("not kept").select("locator"))
    left = state.rows(0).join(gone, "locator", "left_anti")
    return left.select(*[F.col("body").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
