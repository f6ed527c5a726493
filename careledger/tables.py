"""Typed sources: the library's tables from Parquet, JSON or a database, by declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Columns of the capture and durable tables.
SCHEMAS: dict[str, str] = {
    "patient": "patient_id long, abha_ref string, gender string, is_synthetic boolean, patient_ref string, display_name string, year_of_birth int",
    "encounter": "encounter_id long, patient_id long, occurred_at date, kind string, confirmed_by string, priority string, headline string, consent_ref string, session_ref string",
    "fact": "session_id long, seq long, fact_id string, path string, value_kind string, value string, tier string, confidence double, recorded_at timestamp, supersede boolean, verbatim string, turn_id string, question_id string, modality string",
    "observation": "patient_id long, encounter_id long, analyte_key string, value double, observed_on date, unit string, range_flag string",
    "medication": "patient_id long, encounter_id long, name string, observed_on date, status string, dose int, line_no int",
    "audit": "id long, chain long, ts timestamp, action string, summary string, consent_ref string",
    "session": "session_id long, consent_ref string, created_at timestamp, last_at timestamp, purged_at timestamp, priority string",
}


def read_table(spark: SparkSession, location: str, schema: str, source: str = "parquet", partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """The table at ``location`` with exactly the columns of ``schema``; nothing is inferred, and only the columns used are read.

    ``source``: parquet, json (a record a line; one that doesn't fit gives nulls), or jdbc, where ``location`` is the URL, the option dbtable names the table and
    ``partition`` (column, least, most, parts) splits the read into parts.
    """
    shape = T._parse_datatype_string(schema)
    reader = spark.read.options(**options)
    if source != "jdbc":
        return reader.schema(shape).format(source).load(location)
    reader = reader.option("url", location)
    if partition:
        column, least, most, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(least), upperBound=str(most), numPartitions=str(parts))
    found = reader.format("jdbc").load()
    return found.select(*[found[f.name].cast(f.dataType).alias(f.name) for f in shape.fields])


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None, source: str = "parquet") -> dict[str, DataFrame]:
    """The named tables of SCHEMAS (all, if none are named) under ``folder``, one file or directory each."""
    return {n: read_table(spark, f"{folder}/{n}.{source}", SCHEMAS[n], source) for n in names or SCHEMAS}
