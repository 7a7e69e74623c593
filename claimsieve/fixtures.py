"""Claims derived from the driver tables; one SQL text serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_K = "get_json_object(props, '$.k')"
DUCKDB_K = "json_extract_string(props, '$.k')"

CLAIMS_SQL = """
SELECT event_id AS row_idx,
 'CLM_' || CAST(event_id % (SELECT CAST(count(*) * 97 / 100 AS BIGINT) FROM {events}) AS STRING) AS claim_id,
 'POL_' || CAST(user_id * 20 + k % 20 AS STRING) AS policy_number,
 CASE WHEN event_id % 211 = 0 THEN NULL WHEN event_id % 223 = 0 THEN CAST(0 AS DOUBLE)
      WHEN event_id % 101 = 0 THEN 10000 * round(value) ELSE round(value * 1000) END AS total_claim_amount,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(hour(ts) AS BIGINT) END AS incident_hour_of_the_day,
 ts AS incident_ts, CAST(ts AS DATE) AS incident_date,
 CASE WHEN event_id % 89 = 0 THEN NULL ELSE 15 + k % 60 END AS age,
 CASE k % 5 WHEN 0 THEN 'OH' WHEN 1 THEN 'NY' WHEN 2 THEN 'CA' WHEN 3 THEN 'TX' ELSE 'IN' END AS incident_state,
 CASE event_id % 3 WHEN 0 THEN 'Minor Damage' WHEN 1 THEN 'Major Damage' ELSE 'Total Loss' END AS incident_severity,
 CASE event_type WHEN 'error' THEN 'Vehicle Theft' WHEN 'click' THEN 'Parked Car'
      WHEN 'view' THEN 'Single Vehicle Collision' ELSE 'Multi-vehicle Collision' END AS incident_type,
 CASE WHEN event_id % 83 = 0 THEN NULL ELSE user_id % 4 END AS witnesses,
 CASE user_id % 10 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'NO' WHEN 2 THEN 'NO' WHEN 3 THEN 'N' ELSE 'YES' END AS police_report_available,
 CASE k % 7 WHEN 0 THEN 'None' WHEN 1 THEN 'Not Reported' ELSE 'Police' END AS authorities_contacted,
 CASE k % 3 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'YES' ELSE 'NO' END AS property_damage,
 2000 + user_id % 24 AS policy_bind_year,
 round(value * (k % 30) * 10) AS injury_claim, round(value * 250) AS property_claim, round(value * 450) AS vehicle_claim,
 CASE WHEN event_id % 13 = 0 THEN NULL WHEN (event_id * 7 + k) % 5 = 0 THEN ' yes ' WHEN k % 2 = 0 THEN '0' ELSE 'N' END AS fraud_reported
FROM (SELECT *, CAST({k} AS BIGINT) AS k FROM {events}) e
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upload every claim query starts from: the whole ``events`` table."""
    return spark.sql(CLAIMS_SQL.format(k=SPARK_K, events="{events}"), events=table(spark, sf_dir, "events"))


def claims_sql() -> str:
    """The same table for the oracle."""
    return CLAIMS_SQL.format(k=DUCKDB_K, events="events")


def timestamp_by_quarter(df: DataFrame) -> DataFrame:
    """Add ``run_id`` (a quarter of a day), ``timestamp`` (its start) for run history queries."""
    start = F.date_trunc("day", "incident_ts")
    quarter = F.floor(F.hour("incident_ts") / 6).cast("int")
    return df.withColumns(
        {
            "run_id": F.concat(F.date_format("incident_ts", "yyyy-MM-dd"), F.lit("_"), quarter.cast("string")),
            "timestamp": start + F.make_dt_interval(F.lit(0), quarter * 6),
        }
    )
