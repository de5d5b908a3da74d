"""Landing-zone files: CSV logs, JSON records, wide sheets, CSV export."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Sequence
from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaguelens.functions.scalars import parse_ts_fmt
from leaguelens.operators.reshape import tidy_header

INDEX_COLUMN = "Unnamed: 0"
LOG_TIME = "M/d/yyyy H:mm"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    times: Sequence[str] = (),
    time_format: str = LOG_TIME,
) -> DataFrame:
    """CSV log; drops a stray index column and parses its text times.

    Without a schema every column is read as text, which needs no inference pass.
    """
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.drop(INDEX_COLUMN, "_c0")
    return df.withColumns({c: parse_ts_fmt(F.col(c), time_format) for c in times})


def read_json_landing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: landed responses, each one JSON array of records.

    A file is one response, so files are the unit of parallelism.
    """
    return spark.read.schema(schema).option("multiLine", True).json(path)


def stream_json_landing(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100):
    """S3: the same landing as a stream of new files."""
    reader = spark.readStream.schema(schema).option("multiLine", True)
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path)


def _header_names(line: str) -> list[str]:
    """Column names of a header line as the CSV reader gives them: numbered where empty or repeated."""
    cells = next(csv.reader([line]))
    seen = Counter(c.lower() for c in cells)
    return [f"_c{i}" if not c else f"{c}{i}" if seen[c.lower()] > 1 else c for i, c in enumerate(cells)]


def _holder(file: str, sheets: dict[str, str]) -> str:
    """Name of the sheet whose path is the file or the folder of the file."""
    at = urlparse(file)
    for name, path in sheets.items():
        given = urlparse(path)
        inside = PurePosixPath(unquote(at.path))
        if given.netloc in ("", at.netloc) and PurePosixPath(given.path) in (inside, inside.parent):
            return name
    raise ValueError(f"{file} belongs to none of {list(sheets)}")


def _cells(spark: SparkSession, paths: Sequence[str], width: int) -> DataFrame:
    """All data rows of all files in one scan: (file, cells by position), header lines left out."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.array(*rows.columns).alias("cells"))


def read_wide_sheets(
    spark: SparkSession, sheets: dict[str, str], id_col: str, var: str, value: str
) -> DataFrame:
    """One CSV per sheet (``{sheet name: path}``, a file or a folder of files), tidied, made long, combined.

    Headers are tidied as ``standardize_headers`` does. One job reads the first line of every file,
    a second one counts the filled cells of ``Unnamed`` columns where there are any; the result is
    one scan of all sheets, whose cells take their names by position. The number of jobs and the
    width of the plan do not depend on the number of sheets. What reaches the driver is one header
    line per file. Files without a line give no rows; lines do not break inside quotes.
    """
    paths = list(sheets.values())
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"),
        "value",
    )
    first = lines.filter("start = 0 AND trim(value) <> ''").groupBy("file").agg(F.min_by("value", "n").alias("line"))
    names = {file: _header_names(line) for file, line in first.collect()}
    holder = {file: _holder(file, sheets) for file in names}
    width = max(map(len, names.values()), default=1)
    cells = _cells(spark, paths, width)

    unnamed = sorted({i for row in names.values() for i, c in enumerate(row) if c.startswith("Unnamed")})
    filled = set()
    if unnamed:
        counts = cells.groupBy("file").agg(*[F.count(F.col("cells")[i]).alias(f"n{i}") for i in unnamed])
        filled = {(holder[r["file"]], names[r["file"]][i]) for r in counts.collect() for i in unnamed if r[f"n{i}"] and i < len(names[r["file"]])}

    heads = []
    for file, row in names.items():
        kept = [(i, c) for i, c in enumerate(row) if not c.startswith("Unnamed") or (holder[file], c) in filled]
        if kept:
            heads.append((file, holder[file], kept[0][0], [(i, tidy_header(c)) for i, c in kept[1:]]))
    head = spark.createDataFrame(heads, "file string, source_sheet string, id int, cols array<struct<pos int, name string>>")
    rows = cells.join(head, "file")
    long = rows.select("cells", "source_sheet", F.col("cells")[F.col("id")].alias(id_col), F.inline("cols").alias("pos", var))
    return long.select(id_col, var, F.col("cells")[F.col("pos")].cast("double").alias(value), "source_sheet")


def export_csv(df: DataFrame, path: str) -> None:
    """Result as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
