"""Directory CSV scan with dialect detection.

Paths are listed through the Hadoop FileSystem API (local, HDFS and object
stores alike); a folder of part files, as Spark writes it, counts as one
file. Each file's dialect is decided from its header alone, falling back to
its name; unknown files are skipped. Headers are read on the executors, one
small read per file. Files of a dialect are grouped by their exact header,
every group is read under its own header, and the groups are united by
column name, so files may differ in column order, in missing columns and in
the unnamed index column that a pandas export carries (``_c0``, dropped).
Values arrive as text; the texts that a data-frame reader takes as missing
become NULL, and the normaliser casts the rest with ``try_cast``.

Row integrity follows the data-frame reader. A file's width is that of its
header or of its first data row, whichever is wider; fields that the first row
has beyond the header are a leading index without a name and are dropped. A
shorter row is filled with NULL, a wider one makes the whole file unreadable:
it is skipped with a warning and its rows are in the report. Every row carries
its file and its surplus of fields (``ROW_FILE``, ``ROW_EXTRA``), so
``normalize.ingest`` decides file by file from its only pass;
``load_directory(check_rows=True)`` decides by a pass of its own and returns
plain tables.
"""

from __future__ import annotations

import csv as _csv
import fnmatch
import posixpath
import sys
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import broadcast_if_small
from ..session import cut_lineage, file_system

# Header columns that identify each dialect, checked in this order.
DIALECT_COLUMNS = [
    ("google", {"metrics_cost_micros", "metrics_conversions_value"}),
    ("bing", {"TimePeriod", "CampaignType"}),
    ("meta", {"cpc", "cpm", "conversion"}),
]
# File-name fragments used when the header is not recognised.
NAME_HINTS = [("google", ("google",)), ("bing", ("bing", "microsoft")), ("meta", ("meta", "facebook"))]
INDEX_COLUMNS = ("_c0", "Unnamed: 0", "")
# Texts that stand for a missing value.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                 "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
HEADER_BYTES = 1 << 16          # read at once
HEADER_MAX = 1 << 24            # a header and first row beyond this are refused
# Columns that every row of a CSV file carries until its file is judged.
ROW_FILE, ROW_EXTRA = "_source_file", "_extra_fields"
CORRUPT = "_corrupt_record"
WARNINGS = 20                   # skipped files named one by one


def list_files(spark: SparkSession, directory: str, pattern: str) -> list[str]:
    """Paths in ``directory`` whose base name matches ``pattern``, sorted: files, and folders of part files."""
    fs, path = file_system(spark, directory)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(path)
                  if fnmatch.fnmatchcase(s.getPath().getName(), pattern))


def csv_files(spark: SparkSession, directory: str) -> list[str]:
    """Every ``*.csv``; ``*.CSV`` only when no lower-case file exists."""
    files = list_files(spark, directory, "*.csv") or list_files(spark, directory, "*.CSV")
    if not files:
        raise FileNotFoundError(f"No CSV files found in '{directory}'")
    return files


def part_files(spark: SparkSession, path: str) -> list[str]:
    """The path itself, or the data files of a folder."""
    fs, where = file_system(spark, path)
    if fs.getFileStatus(where).isFile():
        return [path]
    return sorted(s.getPath().toString() for s in fs.listStatus(where)
                  if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", ".")))


def _records(stream) -> tuple[str, int]:
    """The header line and the number of fields that the first data row has beyond it."""
    data, ended = b"", False
    while True:
        chunk = stream.read(HEADER_BYTES)
        data, ended = data + chunk, not chunk
        text = data.decode("utf-8", "replace").lstrip("\ufeff")
        lines = [x for x in text.split("\n") if x.strip()]
        found = list(islice(_csv.reader(text.splitlines(True)), 4)) if ended or len(lines) > 2 else []
        found = [r for r in found if r]
        if ended or len(found) > 2:       # the last record may be cut off
            break
        if len(data) > HEADER_MAX:
            raise ValueError(f"header and first row are longer than {HEADER_MAX} bytes")
    lead = len(found[1]) - len(found[0]) if len(found) > 1 else 0
    return (lines[0].rstrip("\r") if lines else ""), max(0, lead)


def _first_lines(batches):
    """Header line of each file and the width of its first row, read on an executor."""
    from pyarrow import fs as pafs

    for batch in batches:
        found = []
        for path in batch["path"]:
            try:
                where = path if "://" in path else "file://" + path.removeprefix("file:")
                store, inner = pafs.FileSystem.from_uri(where)
                with store.open_input_stream(inner) as stream:      # compressed files by their extension
                    found.append((path, *_records(stream), None))
            except Exception as exc:  # an unreadable file is a warning, as in the reference
                found.append((path, None, None, f"{type(exc).__name__}: {exc}"[:300]))
        yield pd.DataFrame(found, columns=["path", "line", "lead", "error"])


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line, lead, error): header line and leading index fields of every file, one task per few files."""
    tasks = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks, "path")
    return rows.mapInPandas(_first_lines, "path string, line string, lead int, error string")


def columns_of(line: str) -> list[str]:
    return next(_csv.reader([line]), [])


def _names(line: str, lead: int) -> list[str]:
    """One name per field: leading index fields and unnamed columns by their place, repeated names numbered."""
    out, seen = [f"_lead{i}" for i in range(lead)], {}
    for i, name in enumerate(columns_of(line)):
        name = name or f"Unnamed: {i}"
        n = seen[name.lower()] = seen.get(name.lower(), -1) + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def _fields(record: Column) -> Column:
    """Number of fields of a raw record: separators outside quoted fields, plus one."""
    plain = F.regexp_replace(record, r'(^|,)"(?:[^"]|"")*"(?=,|\r?$)', "$1")
    return F.length(plain) - F.length(F.replace(plain, F.lit(","))) + 1


def read_csv(spark: SparkSession, paths: list[str] | str, line: str, lead: int = 0, multi_line: bool = False) -> DataFrame:
    """CSV files that share header ``line``, as text, with ``ROW_FILE`` and ``ROW_EXTRA`` of every row.

    The unnamed index column and ``lead`` leading fields are dropped, missing texts are NULL. Quotes inside quoted
    fields are doubled. ``multi_line`` admits line breaks inside quoted fields; such a file cannot be split between
    tasks, so it is off by default.
    """
    names = _names(line, lead)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"')
          # all fields are split, or a row's width would not be known
          .option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(paths))
    # Spark refuses to read the raw record alone: a column of the file goes with it
    beside = F.length(F.coalesce(F.col(f"`{names[-1]}`"), F.lit(""))) >= 0 if names else F.lit(True)
    extra = F.when(F.col(CORRUPT).isNull() & beside, 0).otherwise(_fields(F.col(CORRUPT)) - len(names))
    kept = [c for c in names if c not in INDEX_COLUMNS and c not in names[:lead]]
    return df.select(*[F.when(~F.trim(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in kept],
                     F.col("_metadata.file_path").alias(ROW_FILE), extra.alias(ROW_EXTRA))


def detect_dialect(columns: list[str], path: str = "") -> str | None:
    """Dialect from the header (google > bing > meta), else from the file name (S3)."""
    cols = set(columns)
    for name, needed in DIALECT_COLUMNS:
        if needed <= cols:
            return name
    base = posixpath.basename(path).lower()
    for name, hints in NAME_HINTS:
        if any(h in base for h in hints):
            return name
    return None


def detected(spark: SparkSession, paths: list[str]) -> list[tuple[str, str, int, str | None]]:
    """(path, header line, leading fields, dialect) of every readable file; others are reported and skipped."""
    out = []
    for r in headers(spark, paths).orderBy("path").collect():      # one short row per file, like the listing
        if r["error"]:
            print(f"Warning: skipping file {r['path']}: {r['error']}", file=sys.stderr)
        else:
            folder = posixpath.basename(posixpath.dirname(r["path"]))
            out.append((r["path"], r["line"], r["lead"],
                        detect_dialect(columns_of(r["line"]), r["path"]) or detect_dialect([], folder)))
    return out


def read_groups(spark: SparkSession, files: list[tuple[str, str, int]], multi_line: bool = False) -> DataFrame:
    """Files (path, header line, leading fields), each read under its own header, united by column name; absent
    columns are NULL."""
    groups: dict[tuple[str, int], list[str]] = {}
    for path, line, lead in files:
        groups.setdefault((line, lead), []).append(path)
    out = None
    for line, lead in sorted(groups):
        part = read_csv(spark, groups[line, lead], line, lead, multi_line)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def file_report(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, file, rows, long_rows, short_rows, skipped): one row per file; a wider row makes a file unreadable.

    ``rows`` holds ``ROW_FILE`` and ``ROW_EXTRA``, or sums of rows, long and short rows per ``ROW_FILE``.
    """
    if ROW_EXTRA in rows.columns:
        rows = rows.select(*(keys or []), ROW_FILE, *row_marks())
    return (rows.groupBy(*(keys or []), F.col(ROW_FILE).alias("file"))
            .agg(*[F.sum(c).alias(c) for c in ("rows", "long_rows", "short_rows")])
            .withColumn("skipped", F.col("long_rows") > 0))


def row_marks() -> list[Column]:
    """What a row adds to its file's report."""
    return [F.lit(1).cast("long").alias("rows"), F.when(F.col(ROW_EXTRA) > 0, 1).otherwise(0).cast("long").alias("long_rows"),
            F.when(F.col(ROW_EXTRA) < 0, 1).otherwise(0).cast("long").alias("short_rows")]


def warn_skipped(report: DataFrame) -> None:
    """One warning per skipped file, up to ``WARNINGS`` of them, then their number."""
    bad = report.where("skipped")
    for r in bad.orderBy("file").limit(WARNINGS).collect():
        print(f"Warning: skipping file {r['file']}: {r['long_rows']} of {r['rows']} rows have more fields than its "
              f"header and first row", file=sys.stderr)
    more = bad.count() - WARNINGS
    if more > 0:
        print(f"Warning: skipping {more} more files for rows with too many fields", file=sys.stderr)


def without_files(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows of readable files. ``report`` must be a written table of one row per file."""
    bad = report.where("skipped").select(F.col("file").alias(ROW_FILE)).distinct()
    return rows.join(broadcast_if_small(bad), ROW_FILE, "left_anti")


def require(found, directory: str) -> None:
    """Every dialect needs a readable file."""
    missing = [d for d, _ in DIALECT_COLUMNS if d not in found]
    if missing:
        raise FileNotFoundError(f"Could not identify a file for: {', '.join(missing)} in '{directory}'")


def load_directory(spark: SparkSession, directory: str, duplicates: str = "union", multi_line: bool = False,
                   check_rows: bool = True) -> dict[str, DataFrame]:
    """Raw dialect tables of a directory.

    ``duplicates="union"`` reads every file of a dialect; ``"last"`` keeps only the last readable file in sorted path
    order (the reference keeps the last one seen). A dialect with no readable file raises ``FileNotFoundError``.
    ``check_rows=False`` leaves ``ROW_FILE`` and ``ROW_EXTRA`` in the tables and the judgement to ``normalize.ingest``.
    """
    parts = [p for f in csv_files(spark, directory) for p in part_files(spark, f)]
    groups: dict[str, list[tuple[str, str, int]]] = {}
    for path, line, lead, dialect in detected(spark, parts):
        if dialect:
            groups.setdefault(dialect, []).append((path, line, lead))
    require(groups, directory)
    raws = {d: read_groups(spark, files, multi_line) for d, files in groups.items()}
    if not check_rows and duplicates != "last":
        return raws
    rows = None
    for d, df in raws.items():
        part = df.select(F.lit(d).alias("dialect"), ROW_FILE, ROW_EXTRA)
        rows = part if rows is None else rows.unionByName(part)
    report = cut_lineage(file_report(rows, ["dialect"]), "csv-files")
    warn_skipped(report)
    # one row per dialect
    kept = {r["dialect"]: r["last"] for r in report.where("not skipped").groupBy("dialect").agg(F.max("file").alias("last")).collect()}
    require(kept, directory)
    if duplicates == "last":
        raws = {d: df.where(F.col(ROW_FILE) == kept[d]) for d, df in raws.items()}
    elif report.where("skipped").count():
        raws = {d: without_files(df, report) for d, df in raws.items()}
    return {d: df.drop(ROW_FILE, ROW_EXTRA) for d, df in raws.items()} if check_rows else raws


def load_by_pattern(spark: SparkSession, directory: str, pattern: str, multi_line: bool = False) -> DataFrame:
    """First file matching ``pattern`` (lower-case pattern tried second) (S2); a file with wider rows raises ``ValueError``."""
    files = list_files(spark, directory, pattern) or list_files(spark, directory, pattern.lower())
    if not files:
        raise FileNotFoundError(f"No file matching pattern '{pattern}' found in '{directory}'")
    found = [(p, line, lead) for p, line, lead, _ in detected(spark, part_files(spark, files[0]))]
    raw = read_groups(spark, found, multi_line)
    if raw.where(F.col(ROW_EXTRA) > 0).limit(1).count():
        raise ValueError(f"'{files[0]}' has rows with more fields than its header and first row")
    return raw.drop(ROW_FILE, ROW_EXTRA)
