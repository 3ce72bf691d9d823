"""Readers. Each returns a lazy DataFrame whose filters and column choice reach the scan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaspark.functions import missing, text
from areaspark.operators import address, joins

_SKIP = "skip_"
#: Text of a row that doesn't fit the declared columns.
BAD_ROW = "_bad_row"


def csv_rows(
    spark: SparkSession, path: str, schema: str | T.StructType, header: Sequence[str] | None = None, any_header: bool = False
) -> DataFrame:
    """CSV with declared types by position, and ``_bad_row``: the text of a row with a cell of another type or
    another number of cells, NULL for the others.

    A row is judged by the columns a job asks for, so ask for all: :func:`csv_typed` and :func:`csv_quarantine` do.
    The header of every file must hold the names in ``header`` (without it, those of the schema), in order; another one stops
    the read, unless ``any_header``.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if BAD_ROW in kinds.names:
        raise ValueError(f"a column may not be named {BAD_ROW}")
    names = list(header or kinds.names)
    if len(names) != len(kinds):
        raise ValueError(f"{len(names)} names in the header, {len(kinds)} columns")
    read = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kinds)] + [T.StructField(BAD_ROW, T.StringType())])
    reader = spark.read.schema(read).option("header", True).option("enforceSchema", any_header)
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_ROW).csv(path)
    return df.toDF(*kinds.names, BAD_ROW)


def _kept(df: DataFrame) -> DataFrame:
    return df.select([c for c in df.columns if not c.startswith(_SKIP) and c != BAD_ROW])


def csv_typed(
    spark: SparkSession, path: str, schema: str | T.StructType, header: Sequence[str] | None = None, any_header: bool = False
) -> DataFrame:
    """The same without columns named ``skip_*``; a row that doesn't fit stops the job with its text."""
    df = csv_rows(spark, path, schema, header, any_header)
    # naming all columns makes the reader parse them all, whatever the job asks for
    told = F.concat(F.lit("row does not fit the columns: "), F.col(BAD_ROW), F.lit(", read as "), F.to_csv(F.struct(*df.columns[:-1])))
    stop = F.raise_error(told).cast("boolean")
    return _kept(df.where(F.when(F.col(BAD_ROW).isNotNull(), stop).otherwise(F.lit(True))))


def csv_quarantine(
    spark: SparkSession, path: str, schema: str | T.StructType, keep: Callable[[DataFrame], DataFrame],
    header: Sequence[str] | None = None, any_header: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and the others as ``value`` (their text) and ``file``, for :func:`areaspark.sources.sinks.write_bad_rows`.

    Both come from one read of all columns, which ``keep`` writes, see :func:`areaspark.session.keep`.
    """
    df = keep(csv_rows(spark, path, schema, header, any_header).withColumn("_file", F.input_file_name()))
    good = _kept(df.where(F.col(BAD_ROW).isNull()).drop("_file"))
    return good, df.where(F.col(BAD_ROW).isNotNull()).select(F.col(BAD_ROW).alias("value"), F.col("_file").alias("file"))


def csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with types inferred: an extra pass over the file, for exploration. Rows of another length stop the job."""
    return csv_typed(spark, path, spark.read.option("header", True).option("inferSchema", True).csv(path).schema)


def tokens(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    delimiter: str = " ",
    header: bool = True,
    surplus: str = "error",
) -> DataFrame:
    """Text lines with uneven word counts, after a header line in each file.

    Missing words are NULL; surplus words are an error, or stay with the last one ("merge").
    """
    lines = spark.read.schema("value string").option("header", header).option("sep", "\u0001").option("quote", "").csv(path)
    return token_columns(lines, columns, delimiter, surplus)


def token_columns(lines: DataFrame, columns: Sequence[str], delimiter: str = " ", surplus: str = "error") -> DataFrame:
    """Words of the column ``value`` as columns."""
    words = text.split_columns("value", delimiter, columns, surplus)
    return lines.select([c.alias(n) for n, c in words.items()])


def long_survey(
    survey: DataFrame,
    geography: str,
    variables: Sequence[str],
    states: Sequence[str] | None = None,
    counties: Sequence[str] | None = None,
    year: int | None = None,
) -> DataFrame:
    """Survey rows of one geography. Stored by geography, state and year, the
    conditions prune partitions; all states come in one scan."""
    out = survey.where((F.col("geography") == geography) & F.col("variable").isin(list(variables)))
    if states is not None:
        out = out.where(F.col("state").isin(list(states)))
    if counties is not None:
        out = out.where(F.col("county").isin(list(counties)))
    if year is not None:
        out = out.where(F.col("year") == year)
    return out.select("GEOID", "NAME", "variable", "estimate")


def dictionary_for(dictionary: DataFrame, variables: Sequence[str], column: str = "name") -> DataFrame:
    return dictionary.where(missing.is_in(column, variables))


def match_dictionaries(left: DataFrame, right: DataFrame) -> DataFrame:
    """Variables of one geography with the same label and concept in another."""
    return joins.null_safe_join(left, right, ["label", "concept"], "left")


def sql_query(spark: SparkSession, query: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Result of a query over named tables, written ``{name}`` in the text."""
    return spark.sql(query, **tables)


def jdbc_query(
    spark: SparkSession,
    url: str,
    query: str,
    partition: tuple[str, str, str, int] | None = None,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """The same from a remote database.

    ``partition`` is (column, lower, upper, parts): one connection per slice, so
    the result is read in parallel rather than through one task.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    if partition is None:
        return reader.option("query", query).load()
    column, lower, upper, parts = partition
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", parts)
        .load()
    )


def boundaries(edges: DataFrame, states: Sequence[str], counties: Sequence[str] | None = None) -> DataFrame:
    """Polygon edges of the wanted states and counties."""
    out = edges.where(F.col("state").isin(list(states)))
    return out if counties is None else out.where(F.col("county").isin(list(counties)))


def geocode_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Geocoder output, precise matches only, as X and Y. The file names its columns as the schema does."""
    return address.precise_only(csv_typed(spark, path, schema)).select("ID", F.col("lon").alias("X"), F.col("lat").alias("Y"))
