"""Sinks and bundle storage.

* features: Parquet partitioned by channel, rows sorted by (campaign_type, date)
  inside each file (S5, O2)
* predictions: one ordered CSV file with a header (or a folder of part files), plus the declared schema to read it
  back (S6, S7)
* bundle: versions of a directory of Parquet tables instead of a pickle (S8)
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, file_system

PREDICTIONS_SCHEMA = (
    "forecast_period_days long, channel string, campaign_type string, revenue_p10 double, "
    "revenue_p50 double, revenue_p90 double, roas_p10 double, roas_p50 double, roas_p90 double, "
    "spend_input double, budget_scenario string, causal_summary string"
)
BUNDLE_TABLES = ("residuals", "group_models", "summaries", "group_stats", "anomalies", "metadata")
MANIFEST = "_MANIFEST.json"      # written last: a version without it is not complete
KEPT_VERSIONS = 2


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint directory (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "adyield-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def write_features(features: DataFrame, path: str) -> None:
    """Features Parquet, one directory per channel, rows ordered inside files."""
    (features.repartition("channel", "campaign_type")
     .sortWithinPartitions("channel", "campaign_type", "date")
     .write.mode("overwrite").partitionBy("channel").parquet(path))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_predictions_csv(pred: DataFrame, path: str) -> None:
    """Predictions as CSV with a header (S6). Text fields are quoted and may hold newlines.

    A path that ends in ``.csv`` becomes one file in the order of ``pred`` (O3): ordered part files are written next to
    it, joined by the file system as streams, and the whole is renamed to its name, so a reader sees the old file or the new
    one. Predictions have 15 rows per group. Any other path becomes a folder of part files.
    """
    options = {"quoteAll": True, "escape": '"'}
    if not path.lower().endswith(".csv"):
        pred.write.mode("overwrite").options(header=True, **options).csv(path)
        return
    spark = pred.sparkSession
    fs, target = file_system(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = f"{path}.parts-{uuid.uuid4().hex[:8]}"
    try:
        pred.write.options(header=False, **options).csv(parts)
        _, folder = file_system(spark, parts)
        _, whole = file_system(spark, f"{parts}/whole")
        names = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        out = fs.create(whole)
        try:
            out.write(bytearray((",".join(f'"{c}"' for c in pred.columns) + "\n").encode()))
            for name in names:
                part = fs.open(file_system(spark, name)[1])
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
        finally:
            out.close()
        fs.delete(target, True)
        if not fs.rename(whole, target):
            raise OSError(f"cannot rename {whole} to {path}")
    finally:
        fs.delete(file_system(spark, parts)[1], True)


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Predictions CSV with the declared schema."""
    return (spark.read.schema(PREDICTIONS_SCHEMA).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def _versions(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(folder, complete) of the versions under ``path``, oldest first."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return []
    found = sorted(s.getPath().toString() for s in fs.listStatus(where) if re.match(r"version-\d+-", s.getPath().getName()))
    return [(f, fs.exists(file_system(spark, os.path.join(f, MANIFEST))[1])) for f in found]


def new_version(spark: SparkSession, path: str) -> str:
    """Folder of the next version of the bundle at ``path``; nobody reads it before ``commit_version``."""
    numbers = [int(re.search(r"version-(\d+)-", f)[1]) for f, _ in _versions(spark, path)]
    return os.path.join(path, f"version-{max(numbers, default=0) + 1:08d}-{uuid.uuid4().hex[:8]}")


def commit_version(spark: SparkSession, version: str, content: dict) -> None:
    """Make a written version the current one: its manifest is written beside its name and renamed, last of all.

    Versions before the last ``KEPT_VERSIONS`` complete ones are removed; a reader of the version before keeps its files.
    """
    fs, ready = file_system(spark, os.path.join(version, MANIFEST))
    _, draft = file_system(spark, os.path.join(version, f".{MANIFEST}.tmp"))
    out = fs.create(draft)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    if not fs.rename(draft, ready):
        raise OSError(f"cannot commit {version}")
    every = _versions(spark, os.path.dirname(version))
    kept = [f for f, complete in every if complete][-KEPT_VERSIONS:]
    for folder, _ in every:
        if folder < kept[0]:
            fs.delete(file_system(spark, folder)[1], True)


def current_version(spark: SparkSession, path: str) -> str:
    """The newest complete version of the bundle at ``path``."""
    complete = [f for f, done in _versions(spark, path) if done]
    if not complete:
        raise FileNotFoundError(f"No complete bundle in '{path}'")
    return complete[-1]


def save_bundle(path: str, tables: dict[str, DataFrame]) -> None:
    """Tables of a bundle version (S8), one Parquet table per name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def load_bundle(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default the current one."""
    version = version or current_version(spark, path)
    return {name: spark.read.parquet(os.path.join(version, name)) for name in BUNDLE_TABLES}


def export_csv(df: DataFrame, path: str, with_index: bool = True, null_text: str = "") -> None:
    """One dialect's rows as CSV export files with a header each, into folder ``path``.

    ``with_index`` adds the unnamed leading index column that a pandas export has.
    """
    out = df.select(F.monotonically_increasing_id().alias("_c0"), *df.columns) if with_index else df
    (out.write.mode("append").option("header", True).option("emptyValue", "").option("nullValue", null_text)
     .option("escape", '"').csv(path))


def export_dialect_csv(raws: dict[str, DataFrame], directory: str, with_index: bool = True) -> None:
    """Raw dialect tables as one directory of mixed platform exports."""
    for df in raws.values():
        export_csv(df, directory, with_index)
