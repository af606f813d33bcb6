"""CSV history: one file, or one folder of part files, per symbol.

The symbol comes from the path: ``NVDA.csv``, ``NVDA.csv/part-0001.csv`` or
``symbol=NVDA/part-0001.csv``. A quoted cell may span lines, so a file is read
by one task; a large symbol should be a folder of part files.

Files are parsed once, into a table in the shared folder. A file with a row of more
cells than its header, or with a quote that is never closed, gives no rows at all and
counts as unreadable: nobody can tell which of its cells shifted. A row with fewer
cells is complete, the missing ones are NULL.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.functions.clean import null_if_na
from newsflow.session import settled
from newsflow.stocks import SYMBOLS

_HEADER_READERS = 16
# A cell in quotes, and a cell that begins with one.
_QUOTED = r'(?:(?<=^)|(?<=[,\n]))"(?:[^"]|"")*"(?=[,\n]|$)'
_OPENED = r'(?:^|[,\n])"'


@dataclass(frozen=True)
class CsvScan:
    """Rows of all readable files, the files that could not be read, and those passed over.

    Unreadable are files that are empty, lack the key column or are malformed. Passed over are files of the configured symbols that are not plain CSV files,
    such as compressed ones.
    """

    rows: DataFrame
    unreadable: tuple[str, ...]
    passed_over: tuple[str, ...] = ()


def _symbol_pattern(suffix: str) -> str:
    return rf"/(?:symbol=([^/]+)/[^/]*|([^/]+?){suffix}\.csv(?:/[^/]*)?)$"


def _symbol_from_path(path: Column, suffix: str) -> Column:
    names = [F.nullif(F.regexp_extract(path, _symbol_pattern(suffix), g), F.lit("")) for g in (1, 2)]
    return F.url_decode(F.coalesce(*names))


def _symbol_of_file(path: str, suffix: str) -> str | None:
    found = re.search(_symbol_pattern(suffix), path)
    return unquote(found[1] or found[2]) if found else None


def _list_files(spark: SparkSession, path: str) -> list[str]:
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return sorted(listing.inputFiles())


def _header(spark: SparkSession, file: str) -> tuple[str, ...] | None:
    """Header cells of a file, None when it is empty or no CSV.

    A cell may be empty: that is how an index column is written. Anything but a
    parse error is raised, so a passing storage error never drops a symbol.
    """
    try:
        rows = spark.read.csv(file, header=False, multiLine=True, escape='"').take(1)
    except PySparkException as error:
        if "TextParsingException" in str(error) or "MALFORMED" in (error.getCondition() or ""):
            return None
        raise
    if not rows or all(cell is None for cell in rows[0]):
        return None
    return tuple("" if cell is None else str(cell).strip() for cell in rows[0])


def _fields(header: tuple[str, ...]) -> list[str]:
    """One name per position: the header's, unless it is empty or was there before."""
    return [
        name if name and name not in header[:i] else f"_unnamed_{i}" for i, name in enumerate(header)
    ]


def _cells_too_many(record: Column, cells: int) -> Column:
    """Whether a record that does not fit the header has more cells than it."""
    return F.size(F.split(F.regexp_replace(record, _QUOTED, ""), ",", -1)) > cells


def _scan(spark: SparkSession, header: tuple[str, ...], members: list[str]) -> tuple[DataFrame, str, str]:
    """Rows of files of one layout, and the names of the columns for malformed records and the last cell."""
    names = _fields(header)
    malformed = "_malformed"
    while malformed in names:
        malformed += "_"
    fields = [T.StructField(name, T.StringType()) for name in [*names, malformed]]
    scan = spark.read.csv(
        members, schema=T.StructType(fields), header=True, multiLine=True, escape='"', columnNameOfCorruptRecord=malformed)
    return scan, malformed, names[-1]


def _malformed_files(spark: SparkSession, rows: DataFrame) -> list[str]:
    """Files of the scan that cannot be trusted, at most one row per file on the driver."""
    judged = rows.groupBy("file_path").agg(
        F.bool_or("broken").alias("broken"), F.max_by("open_end", "row_pos").alias("open_end"))
    found = judged.filter("broken OR open_end").collect()
    # A last cell with line breaks is closed if the file's last line ends with a quote.
    doubtful = [r.file_path for r in found if not r.broken]
    closed = set()
    if doubtful:
        lines = spark.read.text(doubtful).filter(F.trim("value") != "").select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
            F.rtrim("value").endswith('"').alias("closed"))
        ends = lines.groupBy("file").agg(F.max_by("closed", "at").alias("closed"))
        closed = {r.file for r in ends.filter("closed").collect()}
    return sorted(r.file_path for r in found if r.broken or r.file_path not in closed)


def read_symbol_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    symbols: Sequence[str] = SYMBOLS,
    suffix: str = "",
) -> CsvScan:
    """Read the CSVs of the given symbols as text columns plus symbol, rank and row order.

    Files of other symbols are left alone. Every file's header is read, part files
    too. Files are grouped by their header and each group is one scan, so files with
    another column order are read by name, and the plan grows with the number of
    layouts, not of files. Names are taken without the blanks around them; unnamed
    columns are ignored. Cells that spell a missing value become NULL; columns a file
    lacks are NULL. ``row_pos`` grows with the position in a file.
    """
    files, passed_over = [], []
    for file in _list_files(spark, path):
        name = file.rsplit("/", 1)[1]
        if name.startswith(("_", ".")):
            continue
        plain = _symbol_of_file(file, suffix)
        if name.endswith(".csv") and plain in symbols:
            files.append(file)
        elif not name.endswith(".csv"):
            stem = re.sub(r"\.csv\.[^./]+$", ".csv", file)
            if (_symbol_of_file(stem, suffix) or plain) in symbols:
                passed_over.append(file)
    with ThreadPoolExecutor(_HEADER_READERS) as readers:
        headers = list(readers.map(lambda f: _header(spark, f), files))
    layouts: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for file, header in zip(files, headers):
        if header:
            layouts[header].append(file)
    unreadable = [f for f, h in zip(files, headers) if not h]

    rows = None
    for header, members in layouts.items():
        if columns[0] not in header:
            unreadable += members
            continue
        scan, malformed, last = _scan(spark, header, members)
        file, record = F.col("_metadata.file_path"), F.col(malformed)
        broken = record.isNotNull() & (
            _cells_too_many(record, len(header)) | F.regexp_replace(record, _QUOTED, "").rlike(_OPENED))
        layout = scan.select(
            _symbol_from_path(file, suffix).alias("symbol"),
            file.alias("file_path"),
            F.monotonically_increasing_id().alias("row_pos"),
            *[
                (null_if_na(F.col(c)) if c in header else F.lit(None).cast("string")).alias(c)
                for c in columns
            ],
            broken.alias("broken"),
            F.coalesce(F.col(last).contains("\n"), F.lit(False)).alias("open_end"),
        )
        rows = layout if rows is None else rows.unionByName(layout)
    if rows is None:
        nothing = F.lit(None).cast("string")
        rows = spark.range(0).select(
            nothing.alias("symbol"),
            nothing.alias("file_path"),
            F.col("id").alias("row_pos"),
            *[nothing.alias(c) for c in columns],
        )
    else:
        rows = settled(rows, "csv-scan")
        malformed_files = _malformed_files(spark, rows)
        if malformed_files:
            unreadable += malformed_files
            rows = rows.filter(~F.col("file_path").isin(malformed_files))
        rows = rows.drop("broken", "open_end")
    rank = F.array_position(F.array(*[F.lit(s) for s in symbols]), F.col("symbol")) - 1
    return CsvScan(rows.withColumn("symbol_rank", rank.cast("int")), tuple(unreadable), tuple(passed_over))
