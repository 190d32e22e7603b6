"""Flow tables derived from the given ``events`` table, as one SQL text for two dialects.

The dirt (NULL, NaN, infinities, unclean labels) depends on ``event_id`` only, so it is the same in
every engine and at every scale. Every row of ``events`` becomes one flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "spark": {
        "day": """elt(weekday(ts) + 1, 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday',
            'Saturday', 'Sunday')""",
        "k": "get_json_object(props, '$.k')",
    },
    "duckdb": {"day": "dayname(ts)", "k": "json_extract_string(props, '$.k')"},
}

FLOWS = """
select event_id as flow_id,
       concat({day}, '-WorkingHours.csv') as source_file,
       user_id as destination_port,
       event_type as protocol,
       case when event_id % 97 = 0 then cast('Infinity' as double)
            when event_id % 101 = 0 then cast('NaN' as double)
            when event_id % 103 = 0 then null
            else value end as flow_bytes_s,
       case when event_id % 107 = 0 then cast('-Infinity' as double)
            else cast({k} as double) end as flow_iat_mean,
       case when event_id % 89 = 0 then null
            when event_type = 'error' then ' DDoS '
            when event_type = 'signup' then ' benign'
            else 'BENIGN' end as label
from {events}
"""

# Names as a capture tool writes them.
RAW_NAMES = (
    "Flow ID", "Source File", " Destination Port", "Protocol", "Flow Bytes/s", "Flow IAT Mean",
    " Label",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flows(spark: SparkSession, folder: str) -> DataFrame:
    text = FLOWS.format(events="{events}", **DIALECTS["spark"])
    return spark.sql(text, events=table(spark, folder, "events"))


def flows_raw(spark: SparkSession, folder: str) -> DataFrame:
    return flows(spark, folder).toDF(*RAW_NAMES)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rounded, so that many rows share a score."""
    return table(spark, folder, "events").selectExpr(
        "event_id", "case when event_type = 'error' then 1 else 0 end as target",
        "round(value, 1) as score",
    )


def flows_sql() -> str:
    """The DuckDB text of ``flows``."""
    return FLOWS.format(events="events", **DIALECTS["duckdb"])
