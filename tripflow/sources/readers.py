"""Scans: Parquet, CSV under five schema regimes, text lines; schema report and preview."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    IntegralType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from tripflow.sources.staging import new_path


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv_typed(
    spark: SparkSession, path: str, schema: StructType, **options: str
) -> DataFrame:
    """CSV with header under a declared schema.

    ``enforceSchema=false`` compares the header with the schema, so a file of another layout
    fails instead of being read into the wrong columns by position.
    """
    return (
        spark.read.option("header", "true")
        .option("enforceSchema", "false")
        .options(**options)
        .schema(schema)
        .csv(path)
    )


def read_csv_inferred(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """CSV with header and inferred types. Costs a second pass over the file."""
    return (
        spark.read.option("header", "true").option("inferSchema", "true").options(**options)
        .csv(path)
    )


#: Possessive, so that a value of another form is given up without going back. What matches and has neither
#: point nor exponent is a whole number.
_NUMBER = r"^\s*+[+-]?+(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?+\d++)?+\s*+$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?$"
#: What a value can be, with its form: casts alone accept more, such as "1" for a date.
_KINDS = (
    (IntegerType(), _NUMBER), (LongType(), _NUMBER), (DoubleType(), _NUMBER), (DateType(), _DATE),
    (TimestampNTZType(), _TIME), (BooleanType(), r"^(?i:true|false)$"),
)
#: A column's type by the kinds of its values, as bits in the order above: the first that covers them.
_TYPES = (
    (0b1, IntegerType()), (0b11, LongType()), (0b111, DoubleType()), (0b1000, DateType()),
    (0b11000, TimestampNTZType()), (0b100000, BooleanType()),
)


def _kind(value: Column) -> Column:
    """The bit of the narrowest kind that a value is of; that of text if of none."""
    text, number, other = 1 << len(_KINDS), F, F
    whole = ~(value.contains(".") | value.contains("e") | value.contains("E"))
    for i, (kind, form) in enumerate(_KINDS):
        fits = value.try_cast(kind).isNotNull()
        if form == _NUMBER:
            number = number.when(whole & fits if isinstance(kind, IntegralType) else fits, 1 << i)
        else:
            other = other.when(value.rlike(form) & fits, 1 << i)
    return F.when(value.isNull(), None).when(value.rlike(_NUMBER), number.otherwise(text)).otherwise(other.otherwise(text))


def infer_types(texts: DataFrame) -> StructType:
    """The narrowest type of every text column, from all rows in one pass.

    The kinds that a column's values are of are a set, and sets of any split of the rows merge by union:
    tasks send one row of bits a column. Whole numbers widen to longs and doubles, dates to times; any other
    mixture is text, and so is a column without values. Dates and times are in ISO form.
    """
    # One value a row: the test of a value is compiled once, not once a column into a method too long to compile.
    values = texts.select(F.posexplode(F.array(*[F.col(f"`{name}`") for name in texts.columns])).alias("at", "value"))
    found = dict(values.groupBy("at").agg(F.bit_or(_kind(F.col("value")))).collect())

    def resolved(bits: int | None) -> DataType:
        return next((kind for cover, kind in _TYPES if bits and not bits & ~cover), StringType())

    return StructType([StructField(name, resolved(found.get(i))) for i, name in enumerate(texts.columns)])


def read_csv_remembered(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header under types that are inferred once and kept beside it, in ``<path>.schema``.

    The first read looks at all rows in one pass; every later one, of any session, finds the types there
    and reads nothing but what it selects. Remove the file to infer anew.
    """
    kept = f"{path.rstrip('/')}.schema"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        schema = StructType.fromJson(json.loads("".join(r.value for r in spark.read.text(kept, wholetext=True).collect())))
    else:
        schema = infer_types(read_csv_text(spark, path))
        spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.text(kept)
    return read_csv_typed(spark, path, schema)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, every column as text, to be cast afterwards with ``late_cast``."""
    return spark.read.option("header", "true").csv(path)


def late_cast(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns tolerantly; unreadable values become null. Other columns are dropped."""
    return df.select([F.col(name).try_cast(kind).alias(name) for name, kind in types.items()])


def parse_text_lines(
    lines: DataFrame,
    schema: StructType,
    required: list[str] | None = None,
    header: str | None = None,
) -> DataFrame:
    """Comma-separated lines of one ``value`` column to typed rows; bad lines are dropped.

    A line is bad when it has fewer fields than the schema, or when a required field (all, unless
    named) is empty or does not parse. Fields beyond the schema are ignored; a field that is not
    required and does not parse is null. A whole number may be written with a point (``1.0``).
    Header lines, recognised by equality with ``header`` (the field names, unless given), go as
    well, also those in the middle that joined files bring along.
    """
    checked = check_text_lines(lines, schema, required, header)
    return checked.where("reason IS NULL").select("row.*")


def check_text_lines(
    lines: DataFrame,
    schema: StructType,
    required: list[str] | None = None,
    header: str | None = None,
) -> DataFrame:
    """(value, row, reason) of every line: the typed row and a null, or why the line is none.

    The reasons are ``header``, ``too few fields`` and ``unreadable:`` with the required fields that
    are empty or don't parse. See ``parse_text_lines``.
    """
    header = ",".join(schema.fieldNames()) if header is None else header
    texts = StructType([StructField(name, StringType()) for name in schema.fieldNames()])
    fields = F.from_csv(F.col("value"), texts.toDDL(), {"mode": "PERMISSIVE"})
    unquoted = F.regexp_replace(F.col("value"), '"[^"]*"', "")
    enough = F.size(F.split(unquoted, ",", -1)) >= len(schema)
    typed = F.struct(*[_typed(F.col(f"_line.{f.name}"), f.dataType).alias(f.name) for f in schema])
    parsed = lines.select("value", fields.alias("_line")).select("value", typed.alias("row"))
    unread = F.array_compact(F.array(*[
        F.when(F.col("row").getField(name).isNull(), F.lit(name)) for name in required or schema.fieldNames()
    ]))
    reason = (
        F.when(F.col("value") == header, "header")
        .when(~enough, "too few fields")
        .when(F.size(unread) > 0, F.concat(F.lit("unreadable: "), F.array_join(unread, " ")))
    )
    return parsed.select("value", "row", reason.alias("reason"))


def split_text_lines(
    lines: DataFrame,
    schema: StructType,
    required: list[str] | None = None,
    header: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and (value, reason) of all other lines, both from one pass over the lines.

    The pass writes every line to one of two folders of the shared folder, which the frames then read.
    """
    checked = check_text_lines(lines, schema, required, header)
    bad = F.col("reason").isNotNull()
    out = new_path(lines.sparkSession, "lines")
    both = checked.select(
        F.when(bad, F.col("value")).alias("value"), F.when(~bad, F.col("row")).alias("row"), "reason", bad.alias("rejected")
    )
    both.write.partitionBy("rejected").parquet(out)
    read = lines.sparkSession.read.schema(both.schema).parquet(out)
    return read.where("NOT rejected").select("row.*"), read.where("rejected").select("value", "reason")


def _typed(text: Column, kind: DataType) -> Column:
    value = text.try_cast(kind)
    if isinstance(kind, IntegralType):
        number = text.try_cast("double")
        value = F.coalesce(value, F.when(number == F.floor(number), number.try_cast(kind)))
    return value


def read_text_lines(
    spark: SparkSession, path: str, schema: StructType, required: list[str] | None = None
) -> DataFrame:
    return parse_text_lines(spark.read.text(path), schema, required)


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and number of values present, in one scan."""
    counts = df.agg(*[F.count(F.col(name)).alias(name) for name in df.columns])
    entries = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(field.name).alias("name"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col(field.name).alias("present"),
        )
        for position, field in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*entries)))


def preview_rows(df: DataFrame, columns: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of some columns in a stated order, so that the preview is repeatable."""
    return df.select(*columns).orderBy(*order).limit(n)
