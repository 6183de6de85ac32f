"""File and record sources, and the table sinks (SRC1-6, SNK3-4).

Readers take an explicit schema (no inference pass over the data) and keep
TotalCharges as text so cleaning decides what a blank means. Size guards of
the request API become optional checks, never caps: a batch over the limit is
rejected, not truncated.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ID_COL, MAX_CSV_BATCH, MAX_JSON_BATCH, RAW_SUBSCRIBER, REQUIRED_COLUMNS


def read_subscribers_csv(spark: SparkSession, path: str, schema=RAW_SUBSCRIBER, recursive: bool = False) -> DataFrame:
    """SRC1 / SRC3: CSV folder or file with a header, typed by ``schema``.

    Malformed lines are kept in ``_corrupt_record`` (PERMISSIVE) for quarantine.
    """
    with_corrupt = schema if "_corrupt_record" in schema.fieldNames() else \
        T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(with_corrupt).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("recursiveFileLookup", recursive).csv(path))


def read_records_json(spark: SparkSession, path: str, schema=RAW_SUBSCRIBER, recursive: bool = False) -> DataFrame:
    """SRC4: JSON-lines records (a batch scoring request)."""
    return spark.read.schema(schema).option("recursiveFileLookup", recursive).json(path)


def records_frame(spark: SparkSession, records: Iterable[Mapping], schema=RAW_SUBSCRIBER) -> DataFrame:
    """SRC5: one or a few literal records as a DataFrame with the fixed schema.

    Numbers given for text fields (e.g. TotalCharges 670.2) are kept as text.
    """
    rows = []
    names = schema.fieldNames()
    for r in records:
        if not isinstance(r, Mapping):
            raise TypeError(f"record must be a mapping, got {type(r).__name__}")
        row = []
        for f in schema.fields:
            v = r.get(f.name)
            if v is not None and f.dataType.simpleString() == "string" and not isinstance(v, str):
                v = str(v)
            row.append(v)
        rows.append(tuple(row))
    return spark.createDataFrame(rows, schema).select(*names)


def validate_schema(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> bool:
    """SRC2: raise with the missing set when required columns are absent."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    return True


def check_batch(df: DataFrame, max_rows: int | None) -> DataFrame:
    """SRC3/SRC4 guards: non-empty and at most ``max_rows`` (reject, never truncate)."""
    if df.isEmpty():
        raise ValueError("empty batch")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"batch exceeds {max_rows} rows")
    return df


def read_batch_csv(spark: SparkSession, path: str, max_rows: int | None = MAX_CSV_BATCH) -> DataFrame:
    """SRC3: a batch scoring file: .csv only, not empty, at most ``max_rows`` rows."""
    if not path.endswith(".csv"):
        raise ValueError("only .csv files are accepted")
    return check_batch(read_subscribers_csv(spark, path), max_rows)


def read_batch_json(spark: SparkSession, path: str, max_rows: int | None = MAX_JSON_BATCH) -> DataFrame:
    """SRC4: a batch scoring request of 1 to ``max_rows`` records."""
    return check_batch(read_records_json(spark, path), max_rows)


BATCH_READERS = {".csv": (read_subscribers_csv, MAX_CSV_BATCH), ".json": (read_records_json, MAX_JSON_BATCH)}


def read_batch_folder(spark: SparkSession, folder: str, suffix: str,
                      max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC3/SRC4 for a folder of request files: (rows of accepted files, one verdict per file).

    Each file is a request of its own and is taken or refused as a whole: ``wrong type``, ``empty`` or ``too long``
    (more rows than ``max_rows``, by default the service's limit for the type). Rows carry ``request_file``; the
    verdicts are ``request_file, n_rows, verdict``. All files are checked in one pass, no file at a time.
    """
    read, limit = BATCH_READERS[suffix]
    limit = limit if max_rows is None else max_rows
    file = F.col("_metadata.file_path").alias("request_file")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(file)
    rows = read(spark, folder, recursive=True).select("*", file).where(F.col("request_file").endswith(suffix))
    sizes = rows.groupBy("request_file").agg(F.count(F.lit(1)).alias("n_rows"))
    n = F.col("n_rows")
    verdicts = listed.join(sizes, "request_file", "left").select(
        "request_file", F.coalesce(n, F.lit(0)).alias("n_rows"),
        F.when(~F.col("request_file").endswith(suffix), "wrong type").when(n.isNull(), "empty")
        .when(n > limit, "too long").otherwise("ok").alias("verdict"))
    accepted = verdicts.where("verdict = 'ok'").select("request_file")
    return rows.join(accepted, "request_file", "left_semi"), verdicts


def read_splits(spark: SparkSession, path: str, label: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """SRC6: X_train, X_test, y_train, y_test of a table that ``write_table`` stored by ``split``."""
    stored = spark.read.parquet(path)
    parts = [stored.where(F.col("split") == s).drop("split") for s in ("train", "test")]
    return (*(p.drop(label) for p in parts), *(p.select(ID_COL, label) for p in parts))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """SNK3/SNK4: write a result or split table as Parquet."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
