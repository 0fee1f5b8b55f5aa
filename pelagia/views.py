"""Views of the given tables in the shapes that the operators take; the same text serves Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"{TS}": "CAST(ts AS TIMESTAMP)", "{US}": "unix_micros(ts)", "{EUS}": "unix_micros(CAST(e.ts AS TIMESTAMP))", "{STR}": "STRING", "{IDIV}": "DIV", "{F_ISO}": "date_format(ts,'yyyy-MM-dd HH:mm:ss')", "{F_US}": "date_format(ts,'MM/dd/yyyy HH:mm:ss')", "{F_DOT}": "date_format(ts,'dd.MM.yyyy HH:mm:ss')"}
_DUCK = {"{TS}": "ts", "{US}": "epoch_us(ts)", "{EUS}": "epoch_us(e.ts)", "{STR}": "VARCHAR", "{IDIV}": "//", "{F_ISO}": "strftime(ts,'%Y-%m-%d %H:%M:%S')", "{F_US}": "strftime(ts,'%m/%d/%Y %H:%M:%S')", "{F_DOT}": "strftime(ts,'%d.%m.%Y %H:%M:%S')"}

VIEWS = {
    "v_telemetry": """SELECT user_id AS deployment_id, event_id AS row_no, {TS} AS ts,
      -30 + CAST(event_id * 7919 % 10007 AS DOUBLE) / 10007 AS x, 10 + CAST(event_id * 104729 % 10009 AS DOUBLE) / 10009 AS y,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE -value END AS z, CASE WHEN event_id % 3 = 0 THEN value % 360 END AS heading,
      CAST(event_id % 41 - 20 AS DOUBLE) AS pitch, CAST(event_id % 13 - 6 AS DOUBLE) AS roll
      FROM events WHERE event_type <> 'click'""",
    "v_telemetry_raw": """SELECT deployment_id, row_no,
      CASE row_no % 5 WHEN 0 THEN CAST({US} AS {STR}) WHEN 1 THEN CAST({US} {IDIV} 1000 AS {STR}) WHEN 2 THEN {F_ISO} WHEN 3 THEN {F_US}
        ELSE CASE WHEN row_no % 20 = 4 THEN 'n/a' ELSE {F_DOT} END END AS time_text,
      CASE WHEN row_no % 17 = 0 THEN 'NULL' WHEN row_no % 19 = 0 THEN ' - ' ELSE CAST(row_no % 100 AS {STR}) END AS x_text
      FROM v_telemetry""",
    "v_frames": """SELECT e.user_id AS deployment_id, e.event_id AS row_no,
      CASE WHEN e.event_id % 11 = 0 THEN concat('still', e.event_id, '.tif') ELSE concat('dive', e.user_id, '_', ({EUS} - s.us0) {IDIV} 1000, '.tif') END AS filename,
      CASE e.event_id % 3 WHEN 0 THEN CAST(e.event_id % 1500 AS {STR}) WHEN 1 THEN concat(e.event_id % 1500, '.0') ELSE concat(' ', e.event_id % 1500, ' ') END AS camera_id
      FROM events e JOIN (SELECT deployment_id, min({US}) AS us0 FROM v_telemetry GROUP BY deployment_id) s ON s.deployment_id = e.user_id
      WHERE e.event_type = 'click' AND {EUS} >= s.us0""",
    "v_cameras": """SELECT s_suppkey AS row_no, CAST(s_suppkey AS {STR}) AS camera_id, 640 AS ncols, 480 AS nrows, 'nan' AS focal_length, s_acctbal AS pixel_size FROM supplier""",
    "v_files": """SELECT concat('set', doc_id % 20, '/img_', doc_id, '.tif') AS path, doc_id % 20 AS set_id, text AS body FROM documents""",
    "v_packet_index": """SELECT video_id, n, CAST(33367 * (n + 7 * (n {IDIV} 20)) AS DOUBLE) / 1000000 AS pts, CAST(29.97 AS DOUBLE) AS frame_rate
      FROM (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)""",
}
_NEEDS = {"v_telemetry_raw": ["v_telemetry"], "v_frames": ["v_telemetry"]}


def _filled(name: str, tokens: dict[str, str]) -> str:
    text = VIEWS[name]
    for token, value in tokens.items():
        text = text.replace(token, value)
    return text


def _with(names: tuple[str, ...], tokens: dict[str, str]) -> list[str]:
    order: list[str] = []
    for name in names:
        order += [n for n in (*_NEEDS.get(name, ()), name) if n not in order]
    return [f"{n} AS ({_filled(n, tokens)})" for n in order]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of a data folder. Times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    tables = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in ("events", "supplier", "documents") if f" {t}" in _filled(name, _SPARK) + "".join(_filled(n, _SPARK) for n in _NEEDS.get(name, ()))]
    return spark.sql(f"WITH {', '.join(tables + _with((name,), _SPARK)[:-1])} {_filled(name, _SPARK)}")


def duck(sql: str, *names: str) -> str:
    """DuckDB SQL that may use the named views."""
    return f"WITH {', '.join(_with(names, _DUCK))} {sql}" if names else sql
