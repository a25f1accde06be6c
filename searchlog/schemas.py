"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


USERS = _schema(
    ("user_id", T.LongType()),
    ("name", T.StringType()),
    ("case_id", T.StringType()),
    ("user_type", T.StringType()),
)

QUERIES = _schema(
    ("query_id", T.LongType()),
    ("text", T.StringType()),
    ("ts", T.TimestampType()),
    ("is_interactive", T.BooleanType()),
    ("is_suspicious", T.BooleanType()),
    ("execution_time", T.DoubleType()),
    ("earliest_event", T.DoubleType()),
    ("latest_event", T.DoubleType()),
    ("event_range", T.DoubleType()),
    ("is_realtime", T.BooleanType()),
    ("search_type", T.StringType()),
    ("splunk_search_id", T.StringType()),
    ("saved_search_name", T.StringType()),
    ("user_id", T.LongType()),
    ("session_id", T.LongType()),
    ("session_id_all", T.LongType()),
)

SESSIONS = _schema(
    ("session_id", T.LongType()),
    ("user_id", T.LongType()),
    ("session_seq", T.LongType()),
    ("start_ts", T.TimestampType()),
    ("end_ts", T.TimestampType()),
    ("duration_s", T.DoubleType()),
    ("n_queries", T.LongType()),
)

STAGES = _schema(
    ("query_id", T.LongType()),
    ("position", T.IntegerType()),
    ("depth", T.IntegerType()),
    ("command", T.StringType()),
    ("token_class", T.StringType()),
    ("args", T.StringType()),
    ("stage_text", T.StringType()),
    ("stage_key", T.StringType()),
)

TABLES = {
    "users": USERS,
    "queries": QUERIES,
    "sessions": SESSIONS,
    "sessions_all": SESSIONS,
    "stages": STAGES,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns by name and cast them; a column the input lacks becomes null."""

    present = {field.name: field.dataType for field in df.schema.fields}

    def column(field: T.StructField) -> Column:
        if present.get(field.name) == field.dataType:
            return F.col(field.name)
        source = F.col(field.name) if field.name in present else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select([column(field) for field in schema.fields])
