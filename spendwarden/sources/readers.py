"""Landed files and tables as text columns, with a position that follows file order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDEST = 160  # columns of the widest file that read_named takes


def with_position(df: DataFrame) -> DataFrame:
    """_pos rises with file name and row; used wherever the first or last row wins."""
    return df.withColumn("_pos", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))


def read_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", glob: str | None = None) -> DataFrame:
    """Files of one header, quoted line ends included; a file with another header is an error, not silently misread."""
    r = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("enforceSchema", False).option("quote", '"').option("escape", '"')
    if glob:
        r = r.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return with_position(r.csv(path))


def _headings(cells: list[str | None], key: Callable[[str], str]) -> dict[str, int]:
    """Column of each heading; of a repeated one the first, byte order marks left out."""
    out: dict[str, int] = {}
    for i, cell in enumerate(cells):
        name = key((cell or "").removeprefix("\ufeff").removeprefix("\u00ef\u00bb\u00bf"))
        if name:
            out.setdefault(name, i)
    return out


def read_named(spark: SparkSession, path: str | list[str], encoding: str = "ISO-8859-1", glob: str | None = None, key: Callable[[str], str] = str.strip,
               **options: str) -> DataFrame:
    """Files whose headers differ in names, order and number of columns, read by name: _cells (cells by heading) and _pos.

    Every file's own first record says what its columns are; a cell beyond it is named by its number. Headings that
    differ in case are two. Files are streamed by Spark's reader, each by one task; a record of more than WIDEST cells
    is an error. have(), pick() and the like take a field from _cells.
    """
    r = spark.read.option("header", False).option("encoding", encoding).option("multiLine", True).option("quote", '"').option("escape", '"').options(**options)
    if glob:
        r = r.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    cells = [f"c{i}" for i in range(WIDEST + 1)]
    rows = r.schema(", ".join(f"{c} string" for c in cells)).csv(path).select(F.col("_metadata.file_path").alias("file"), *cells)

    def named(part: pa.RecordBatch, head: dict[str, int], first: int) -> pa.RecordBatch:
        n = part.num_rows
        used = {**{str(i): i for i in range(WIDEST) if i not in head.values() and part.column(i + 1).null_count < n}, **head}
        flat = pa.concat_arrays([part.column(i + 1).cast(pa.string()) for i in used.values()]) if used else pa.array([], pa.string())
        across = np.arange(n * len(used)).reshape(len(used), n).T.ravel() if used else np.zeros(0, int)
        keys = pa.array(np.tile(np.array(list(used), object), n), pa.string())
        all_ = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(used)), keys, flat.take(pa.array(across)))
        place = pa.StructArray.from_arrays([part.column(0).cast(pa.string()), pa.array(np.arange(first, first + n))], ["file", "row"])
        return pa.RecordBatch.from_arrays([all_, place], names=["_cells", "_pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, head, row = None, {}, 0
        for batch in batches:
            if batch.column(WIDEST + 1).null_count < batch.num_rows:
                raise ValueError(f"a record of more than {WIDEST} cells in {batch.column(0)[0]}")
            of = np.array(batch.column(0).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a and of[a] != file:
                    file, row = of[a], 0
                    head = _headings([batch.column(i + 1)[a].as_py() for i in range(WIDEST)], key)
                    a += 1
                if b > a:
                    yield named(batch.slice(a, b - a), head, row)
                    row += b - a

    return rows.mapInArrow(run, "_cells map<string,string>, _pos struct<file: string, row: bigint>")


def read_json(spark: SparkSession, path: str, fields: list[str] | None = None, multi_line: bool = False, **options: str) -> DataFrame:
    """Records, one per line or one array per file; numbers stay text."""
    r = spark.read.option("primitivesAsString", True).option("multiLine", multi_line).options(**options)
    if fields:
        r = r.schema(", ".join(f"`{f}` string" for f in fields))
    return with_position(r.json(path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel by ranges of a numeric column."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", column)
            .option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).options(**options).load())


def contribution_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with contrib in their name; all CSV files where there is none."""
    try:
        return read_csv(spark, path, glob="*[cC][oO][nN][tT][rR][iI][bB]*.[cC][sS][vV]")
    except Exception as e:  # noqa: BLE001
        if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
            raise
        return read_csv(spark, path, glob="*.[cC][sS][vV]")


def _may_have(df: DataFrame, name: str) -> bool:
    return "_cells" in df.columns or name in df.columns


def have(df: DataFrame, name: str) -> Column:
    """A column or cell by its exact name, null where the file lacks it."""
    if "_cells" in df.columns:
        return F.try_element_at("_cells", F.lit(name))
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def pick(df: DataFrame, *names: str) -> Column:
    """First non-empty of the named columns, trimmed; empty text where all are missing."""
    tried = [F.nullif(have(df, n), F.lit("")) for n in names if _may_have(df, n)]
    return F.trim(F.coalesce(*tried, F.lit("")))


def filled(df: DataFrame, *names: str) -> Column:
    return F.nullif(pick(df, *names), F.lit(""))


def known(df: DataFrame, *names: str, default: str | None = None) -> Column:
    """First present value, empty text included."""
    return F.coalesce(*[have(df, n) for n in names if _may_have(df, n)], F.lit(default).cast("string"))


def raw(df: DataFrame) -> Column:
    """The whole record as JSON text."""
    return F.to_json("_cells") if "_cells" in df.columns else F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "_pos"]))
