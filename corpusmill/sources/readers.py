"""Readers. Every one is lazy and splits its files among executors; a count of bad lines needs a pass of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import ORDER, Dataset
from ..errors import ConfigError, SchemaError
from .formats import detect

BAD = "_bad"


def read(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | str | None = None, skip_errors: bool = False, max_errors: int | None = 100, delimiter: str = ",", header: bool = True, max_records: int | None = None, id: str | None = None) -> Dataset:
    """A file or folder as a dataset whose payload is its fields.

    json: an array gives its elements, an object itself. csv: strings. skip_errors leaves out lines that are no JSON;
    more than max_errors of them are an error (None: any number). Without a schema JSON is read twice, to infer it.
    """
    name = format or detect(spark, path).name
    if name == "parquet":
        df = spark.read.parquet(path)
    elif name == "csv":
        reader = spark.read.option("sep", delimiter).option("header", header).option("inferSchema", False).option("multiLine", False)
        df = (reader.schema(schema) if schema else reader).csv(path)
    elif name == "json":
        reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED" if skip_errors else "FAILFAST")
        df = (reader.schema(schema) if schema else reader).json(path)
    elif name == "jsonl":
        df = _lines(spark, path, schema, skip_errors, max_errors)
    else:
        raise ConfigError(f"unknown format {name!r}")
    if max_records is not None:
        df = df.limit(max_records)
    return Dataset.of(df, id=id)


def _lines(spark: SparkSession, path: str, schema: T.StructType | str | None, skip_errors: bool, max_errors: int | None) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if schema is None:
        inferred = spark.read.option("columnNameOfCorruptRecord", BAD).json(path).schema
        schema = T.StructType([f for f in inferred if f.name != BAD])
        if not schema.fields:
            raise SchemaError("no line is a JSON object")
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if skip_errors:
        bad = F.try_parse_json("value").isNull()
        # no more of the bad lines are read than decide
        if max_errors is not None and lines.filter(bad).limit(max_errors + 1).count() > max_errors:
            raise SchemaError(f"more than {max_errors} lines are no JSON")
        lines = lines.filter(~bad)
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE" if skip_errors else "FAILFAST"}).alias("r")).select("r.*")


_COMMENT = r"^\s*(#|//|--)"


def read_envelope(spark: SparkSession, path: str, payload: T.StructType | str, metadata: T.StructType | str | None = None, format: str | None = None, allow_comments: bool = False, skip_errors: bool = False, max_records: int | None = None, delimiter: str = ",") -> Dataset:
    """A file of records {id, payload, metadata}, payload and metadata of the given schemas.

    jsonl: a line without payload is its own payload (but for id and metadata); comments begin with #, // or --.
    csv and parquet: payload and metadata are columns of JSON text. A record that is no JSON is left out or an error.
    """
    name = format or detect(spark, path).name
    fields = payload if isinstance(payload, T.StructType) else T.StructType.fromDDL(payload)
    extra = (metadata if isinstance(metadata, T.StructType) else T.StructType.fromDDL(metadata)) if metadata else T.StructType([])
    if name == "jsonl":
        lines = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias(ORDER)).filter(F.trim("value") != "")
        if allow_comments:
            lines = lines.filter(~F.col("value").rlike(_COMMENT))
        outer = T.StructType([T.StructField("id", T.StringType()), T.StructField("payload", fields), T.StructField("metadata", extra)])
        parsed = lines.withColumn("bad", F.try_parse_json("value").isNull()).withColumn("e", F.from_json("value", outer)).withColumn("p", F.from_json("value", fields))
        wrapped = F.get_json_object("value", "$.payload").isNotNull()
        df = parsed.select(ORDER, "bad", F.col("e.id").alias("id"), F.when(wrapped, F.col("e.payload")).otherwise(F.col("p")).alias("payload"), F.col("e.metadata").alias("metadata"))
    elif name in ("csv", "parquet"):
        raw = spark.read.option("sep", delimiter).option("header", True).option("escape", '"').option("multiLine", True).csv(path) if name == "csv" else spark.read.parquet(path)
        if "payload" not in raw.columns:
            raise SchemaError("no column payload")
        ident = F.col("id").cast("string") if "id" in raw.columns else F.lit(None).cast("string")
        meta = F.from_json("metadata", extra) if "metadata" in raw.columns else F.lit(None).cast(extra)
        df = raw.select(F.monotonically_increasing_id().alias(ORDER), F.try_parse_json("payload").isNull().alias("bad"), ident.alias("id"), F.from_json("payload", fields).alias("payload"), meta.alias("metadata"))
    else:
        raise ConfigError(f"envelopes can't be {name!r}")
    if skip_errors:
        df = df.filter(~F.col("bad"))
    else:
        df = df.withColumn("payload", F.when(F.col("bad"), F.raise_error(F.lit("a record is no JSON")).cast(fields)).otherwise(F.col("payload")))
    df = df.drop("bad")
    return Dataset.from_envelope(df.limit(max_records) if max_records is not None else df)
