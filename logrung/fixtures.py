"""Log lines, scored rows and vectors derived from the test tables.

One recipe in SQL serves Spark and the SQL checks; the dialects differ only in
the fragments below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEVEL_CYCLE = (
    "'TRACE','VERBOSE','DEBUG','FINE','INFO','NOTICE','WARN','WARNING','ERROR','SEVERE',"
    "'FATAL','CRITICAL','err','dbg'"
)

_SPARK = {
    "S": "STRING",
    "TS": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    "AT": "element_at(array({}), CAST({} AS INT))",
}
_DUCK = {
    "S": "VARCHAR",
    "TS": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
    "AT": "list_extract([{}], CAST({} AS INT))",
}


def _logv(d: dict[str, str], events: str) -> str:
    s = d["S"]
    level = d["AT"].format(LEVEL_CYCLE, "(user_id % 14) + 1")
    return f"""
SELECT event_id, 'ds' || CAST(user_id % 4 AS {s}) AS dataset,
 CASE CAST(event_id % 12 AS INT)
  WHEN 0 THEN concat(t, ' ', L, ' [worker-', u, '] com.acme.svc.Handler', k, ' - ', event_type, ' took ', v, ' ms')
  WHEN 1 THEN concat(t, ',123 - root - ', L, ' - ', event_type, ' from 10.0.', CAST(user_id % 256 AS {s}), '.', CAST(event_id % 256 AS {s}), ' id ', e)
  WHEN 2 THEN concat('03-17 16:13:38.811 ', u, ' ', e, ' ', substr('TVDIWEF', CAST(user_id % 7 + 1 AS INT), 1), ' ActivityManager: ', event_type, ' ', e, '_', u)
  WHEN 3 THEN concat('- 1117838570 2005.06.03 R02-M1-N0 RAS KERNEL ', upper(L), ' ', event_type, ' corrected ', v)
  WHEN 4 THEN concat(event_type, ' completed for user ', u, ' hex ', substr(md5(e), 1, 12))
  WHEN 5 THEN concat(event_type, ' failed with status ', k)
  WHEN 6 THEN concat('warn ', event_type, ' slow ', v)
  WHEN 7 THEN concat(chr(27), '[1m ', L, ' ', chr(27), '[0m: ', event_type, ' ', v)
  WHEN 8 THEN concat(L, ': upstream host: "api', u, '.example.org" ', e, '#', u, ': *', k, ' uuid ',
       substr(md5(e),1,8), '-', substr(md5(e),9,4), '-', substr(md5(e),13,4), '-', substr(md5(e),17,4), '-', substr(md5(e),21,12))
  WHEN 9 THEN concat(t, ' ', L, ' [x] a.b.Cls - first', chr(10), '  at com.acme.Foo(line ', k, ')')
  WHEN 10 THEN concat(L, ' ', t, ' req] ', event_type, ' ', v)
  ELSE concat('I think ', event_type, ' went wrong: ', v) END AS line,
 CASE CAST(event_id % 12 AS INT) WHEN 5 THEN 'error' WHEN 6 THEN 'warn' WHEN 4 THEN 'unknown' ELSE '' END AS detected_level
FROM (SELECT *, CAST(event_id AS {s}) e, CAST(user_id AS {s}) u, CAST(event_id % 97 AS {s}) k,
        CAST(CAST(floor(value * 100) AS BIGINT) AS {s}) v, {d['TS']} t, {level} AS L
      FROM {events}) x
"""


def _scorev(d: dict[str, str], events: str) -> str:
    observed = d["AT"].format(
        "'TRACE','DEBUG','INFO','WARN','ERROR','FATAL','UNKNOWN','WARNING','CRITICAL','ERR'",
        "user_id % 10 + 1",
    )
    predicted = d["AT"].format(
        "'TRACE','DEBUG','INFO','WARN','ERROR','FATAL'",
        "(CASE WHEN event_id % 5 < 4 THEN user_id % 6 ELSE event_id % 6 END) + 1",
    )
    return f"""
SELECT event_id, {observed} AS observed, {predicted} AS predicted,
       50 + CAST(event_id * 37 % 5000 AS DOUBLE) / 100 AS confidence
FROM {events}
"""


LOGV_SQL = _logv(_DUCK, "events")
SCOREV_SQL = _scorev(_DUCK, "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Shuffle a table of fewer scan tasks than cores over all cores.

    Parsing costs far more than moving a line. A table that is large enough,
    or splits into enough parts, is scanned in parallel already and stays as
    it is; only its number of scan tasks is asked for, not its files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def logv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, dataset, line, detected_level): twelve line shapes."""
    events = spread(table(spark, sf_dir, "events").drop("props"))
    return spark.sql(_logv(_SPARK, "{events}"), events=events)


def scorev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, observed, predicted, confidence), with ties and aliases."""
    return spark.sql(_scorev(_SPARK, "{events}"), events=table(spark, sf_dir, "events"))


def scorev_of(events: DataFrame) -> DataFrame:
    """The scored-row recipe over any events table, streaming ones too."""
    return events.sparkSession.sql(_scorev(_SPARK, "{events}"), events=events)


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
