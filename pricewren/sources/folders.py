"""Folders of mixed files read as one table, and reports written as one file a company."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, IntegerType, LongType, StringType, TimestampType

from pricewren.sources.spreadsheets import read_sheet, with_types
from pricewren.tables import hadoop_path

SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}
#: Types from the narrowest number on; two of a row widen to the later one.
NUMBERS = (BooleanType, IntegerType, LongType, DecimalType, DoubleType)


def wider(a: DataType, b: DataType) -> DataType:
    """The type that holds the values of both: numbers widen, dates become timestamps, anything else becomes text."""
    if a == b:
        return a
    kinds = {type(a), type(b)}
    if kinds == {DateType, TimestampType}:
        return TimestampType()
    if kinds <= set(NUMBERS) and BooleanType not in kinds:
        return DoubleType() if DecimalType in kinds or DoubleType in kinds else LongType()
    return StringType()


def input_files(spark: SparkSession, folder: str) -> list[str]:
    """SRC-04: paths of the folder's delimited files and workbooks in order. The old binary sheets (.xls) are an error, as nothing here reads them."""
    path, system = hadoop_path(spark, folder)
    found = sorted(s.getPath().toString() for s in system.listStatus(path) if s.isFile())
    if sheets := [f for f in found if f.lower().endswith(".xls")]:
        raise ValueError(f"no reader for spreadsheets: {', '.join(sheets)}")
    return [f for f in found if any(f.lower().endswith(e) for e in (*SEPARATORS, ".xlsx"))]


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: a file with a header, types inferred, and ``file_name``: a workbook's first sheet, tabs for .tsv and .txt, else commas."""
    if path.lower().endswith(".xlsx"):
        return with_types(read_sheet(spark, path)).withColumn("file_name", F.lit(path.rsplit("/", 1)[-1]))
    sep = next((s for e, s in SEPARATORS.items() if path.lower().endswith(e)), ",")
    return spark.read.option("header", True).option("inferSchema", True).csv(path, sep=sep).withColumn("file_name", F.col("_metadata.file_name"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a folder's files with all their columns, by name, and ``file_name``.

    A column whose type differs between files gets the wider one; files without it have nulls. A folder without files is an error.
    """
    frames = [read_typed(spark, f) for f in input_files(spark, folder)]
    if not frames:
        raise ValueError(f"no delimited files in {folder}")
    types: dict[str, DataType] = {}
    for frame in frames:
        for field in frame.schema:
            types[field.name] = wider(types.get(field.name, field.dataType), field.dataType)
    alike = [frame.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) for c in frame.columns)) for frame in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alike)


def write_report(df: DataFrame, path: str, order: list[str], by: str | None = None) -> None:
    """SNK-10, SNK-11, SNK-12, SNK-15, SNK-16: df as CSV with a header: one file in order, or with ``by`` one for each value in a folder of its own.

    Cells with separators, quotes or line ends are quoted, quotes in them doubled. Spark's writer puts files in place when
    the whole job has ended; a job that fails leaves none, and what is there already is not overwritten. One file is one
    task's work by its nature: it sorts with what it spills to disk.
    """
    whole = df.repartition(F.col(by)).sortWithinPartitions(by, *order) if by else df.repartition(1).sortWithinPartitions(*order)
    writer = whole.write.mode("errorifexists").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
    (writer.partitionBy(by) if by else writer).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
