"""The registered queries of the engine, each with its DuckDB SQL, over the driver's tables.

``readings`` stands for a fleet's measurements: time in whole seconds, machine, temp, note, device, seq.
Sums of reals are taken in whole cents, so that no result hangs on the order of addition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CorruptError, EngineError, ExistsError, MisuseError, SchemaError
from .functions import scalar as S
from .operators import compare, records, timeseries
from .plans import frames
from .plans.frames import source
from .session import Engine
from .sources import textio
from .sources.recordlog import ROW, Record, decode, encode, pack_row, series_record
from .streaming.sync import BATCH, Gateway
from .types import ColumnDef
from .verify import Verifier, check_seal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: DuckDB's view of ``readings``, put in front of the SQL of queries that read it.
READINGS = "WITH readings AS (SELECT epoch_us(ts) // 1000000 AS time, CAST(user_id % 16 AS INTEGER) AS machine, value AS temp, event_type AS note, user_id AS device, event_id + 1 AS seq, CAST(round(value * 100) AS BIGINT) AS cents FROM events) "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), (F.col("user_id") % 16).cast("int").alias("machine"), F.col("value").alias("temp"),
        F.col("event_type").alias("note"), F.col("user_id").cast("long").alias("device"), (F.col("event_id") + 1).cast("long").alias("seq"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def selected(name: str, text: str, sql: str, table: str = "readings", order: tuple[str, ...] = ("seq",), **more) -> None:
    """A query that runs a SELECT of the language over one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = readings(spark, sf_dir) if table == "readings" else read(spark, sf_dir, table)
        return frames.select(text, **more, **{table: source(df, list(order))})

    QUERIES[name] = run
    SQL[name] = (READINGS if table == "readings" else "") + sql


def scratch(spark: SparkSession) -> Engine:
    """An engine in the folder the cluster shares; in local mode alone a temporary one will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise MisuseError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sensorloom-")
    return Engine(spark, f"{root.rstrip('/')}/engine-{uuid.uuid4().hex}")


T0, T1 = 1704153600, 1704240000

# -- scans

selected("s01_scan", "SELECT time, machine, temp FROM readings", "SELECT time, machine::BIGINT AS machine, temp FROM readings")


@query("s02_time_range", READINGS + f"SELECT time, device, temp FROM readings WHERE time BETWEEN {T0} AND {T1}")
def s02_time_range(spark, sf_dir):
    return timeseries.time_range(readings(spark, sf_dir), "time", T0, T1).select("time", "device", "temp")


@query("s03_kv_lww", "SELECT key, arg_max(props, event_id) AS value FROM (SELECT 'user:' || user_id AS key, * FROM events) GROUP BY key HAVING arg_max(event_type, event_id) <> 'error'")
def s03_kv_lww(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("key", F.concat(F.lit("user:"), F.col("user_id").cast("string")))
    return records.last_write_wins(e, ["key"], "props", "event_id", F.col("event_type") == "error")










@query("s10_last_per_device", READINGS + "SELECT device, max(time) AS time, arg_max(temp, (time, seq)) AS temp, arg_max(seq, (time, seq)) AS seq FROM readings GROUP BY device")
def s10_last_per_device(spark, sf_dir):
    return timeseries.last_of_prefix(readings(spark, sf_dir).select("device", "time", "temp", "seq"), ["device"], ["time", "seq"])


selected("s17_plan_full", "SELECT COUNT(*) AS n FROM readings WHERE (temp = 25.5) OR 0 = 1 OR note LIKE 'pur%'", "SELECT count(*) AS n FROM readings WHERE temp = 25.5::DOUBLE OR note ILIKE 'pur%'")
selected("s18_tableless", "SELECT 1 + 2 AS a, COUNT(*) AS n, -(2 + 3) * 2 AS b, 'it''s' AS t", "SELECT 3::BIGINT AS a, 1::BIGINT AS n, -10::BIGINT AS b, 'it''s' AS t")


@query("s19_catalog", "SELECT * FROM (VALUES ('readings', 'time:time,machine:int,temp:real', '', 'table', ''), ('notes', 'id:int,body:text', 'id', 'table', 'notes_body')) t(name, columns, key, kind, indexes)")
def s19_catalog(spark, sf_dir):
    with scratch(spark) as e:
        e.execute("CREATE TABLE readings (time TIME, machine INT, temp REAL); CREATE TABLE notes (id INT PRIMARY KEY, body TEXT); CREATE UNIQUE INDEX notes_body ON notes (body)")
        return e.tables()


selected("s25_source_names", "SELECT time, temp*2, LENGTH(note) FROM readings WHERE device = 3", 'SELECT time, temp*2 AS "temp*2", strlen(note) AS "LENGTH(note)" FROM readings WHERE device = 3')

# -- projections and predicates

selected("p01_projection", "SELECT * FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, * EXCLUDE (r_regionkey) FROM region", "region", ("r_regionkey",))
selected("p02_alias_chain", "SELECT cents AS a, a * 2 AS b, b + a AS c FROM readings", "SELECT cents AS a, cents * 2 AS b, cents * 3 AS c FROM readings")
selected("p03_alias_where", "SELECT time * 10 AS x, x + 1 AS y, temp AS machine FROM readings WHERE x > 17000000000 AND machine = 4", "SELECT time * 10 AS x, time * 10 + 1 AS y, temp AS machine FROM readings WHERE time * 10 > 17000000000 AND readings.machine = 4")
selected("p03_alias_group", "SELECT machine % 2 AS machine, COUNT(*) AS n FROM readings GROUP BY machine", "SELECT CAST(readings.machine % 2 AS BIGINT) AS machine, count(*) AS n FROM readings GROUP BY readings.machine % 2")
selected("p04_ordinals", "SELECT note, COUNT(*) AS n FROM readings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", "SELECT note, count(*) AS n FROM readings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
selected("p05_where_number", "SELECT COUNT(*) AS n FROM readings WHERE machine", "SELECT count(*) AS n FROM readings WHERE machine <> 0")
selected("p06_cross_type", "SELECT seq, note > 5 AS a, temp = 'x' AS b, 5 < note AS c FROM readings", "SELECT seq, 1::BIGINT AS a, 0::BIGINT AS b, 1::BIGINT AS c FROM readings")
selected("p07_three_valued", "SELECT seq, (1 / (machine % 2) > 0 AND temp > 100) AS a, NOT (1 / (machine % 2)) AS b, (temp > 100 OR NULL) AS c FROM readings", "SELECT seq, CAST((CASE WHEN machine % 2 = 0 THEN NULL ELSE true END AND temp > 100) AS BIGINT) AS a, CAST(CASE WHEN machine % 2 = 0 THEN NULL ELSE false END AS BIGINT) AS b, CAST((temp > 100 OR NULL) AS BIGINT) AS c FROM readings")
selected("p08_is_null", "SELECT COUNT(*) AS n FROM readings WHERE 10 / (machine % 3) IS NULL AND note IS NOT NULL", "SELECT count(*) AS n FROM readings WHERE machine % 3 = 0")
selected("p09_between_null", "SELECT seq, machine BETWEEN 1 / (machine % 2) AND 4 AS a, machine NOT BETWEEN NULL AND 2 AS b FROM readings", "SELECT seq, CAST(CASE WHEN machine % 2 = 0 THEN NULL ELSE machine BETWEEN 1 AND 4 END AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM readings")
selected("p10_like_ci", "SELECT note, COUNT(*) AS n FROM readings WHERE note LIKE 'P%' OR note NOT LIKE '%C_' GROUP BY note", "SELECT note, count(*) AS n FROM readings WHERE note ILIKE 'P%' OR note NOT ILIKE '%C_' GROUP BY note")
selected("p11_in_null", "SELECT seq, machine IN (1, 2, NULL) AS a, machine NOT IN (3, 4) AS b FROM readings", "SELECT seq, CAST(machine IN (1, 2, NULL) AS BIGINT) AS a, CAST(machine NOT IN (3, 4) AS BIGINT) AS b FROM readings")
selected("p12_unary", "SELECT seq, -cents AS a, - -machine AS b, +temp AS c FROM readings", "SELECT seq, -cents AS a, machine::BIGINT AS b, temp AS c FROM readings")
selected("p14_lexer", "SELECT 99999999999999999999 > 1 AS a, 'it''s' AS t, 1e3 AS r -- the rest", "SELECT 1::BIGINT AS a, 'it''s' AS t, 1000.0::DOUBLE AS r")

# -- aggregates

selected("a01_count", "SELECT COUNT(*) AS n, COUNT(1 / (machine % 2)) AS odd FROM readings", "SELECT count(*) AS n, count(CASE WHEN machine % 2 = 0 THEN NULL ELSE 1 END) AS odd FROM readings")
selected("a02_sum", "SELECT machine, SUM(cents) AS s, SUM(note) AS t FROM readings GROUP BY machine", "SELECT machine::BIGINT AS machine, CAST(sum(cents) AS BIGINT) AS s, CAST(NULL AS BIGINT) AS t FROM readings GROUP BY machine")
selected("a02_sum_promote", "SELECT SUM(9000000000000000000 + machine) > 1e19 AS s, SUM(machine) AS m FROM readings", "SELECT 1::BIGINT AS s, CAST(sum(machine) AS DOUBLE) AS m FROM readings", promote=True)
selected("a03_avg", "SELECT machine, ROUND(AVG(cents), 3) AS a FROM readings GROUP BY machine", "SELECT machine::BIGINT AS machine, trunc(sum(cents)::DOUBLE / count(*) * 1000 + 0.5) / 1000 AS a FROM readings GROUP BY machine")
selected("a04_minmax", "SELECT MIN(note) AS a, MAX(note) AS b, MIN(temp) AS c, MAX(time) AS d FROM readings", "SELECT min(note) AS a, max(note) AS b, min(temp) AS c, max(time) AS d FROM readings")
selected("a05_hourly", "SELECT time/3600 AS hour, COUNT(*) AS n, SUM(cents) AS cents, MIN(temp) AS low, MAX(temp) AS high FROM readings GROUP BY hour", "SELECT time // 3600 AS hour, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, min(temp) AS low, max(temp) AS high FROM readings GROUP BY hour")
selected("a06_empty", "SELECT COUNT(*) AS n, SUM(temp) AS s, MIN(note) AS m FROM readings WHERE time < 0", "SELECT count(*) AS n, sum(temp) AS s, min(note) AS m FROM readings WHERE time < 0")
selected("a07_expressions", "SELECT note, SUM(cents) * 2 + COUNT(*) AS a, MAX(machine + device) AS b FROM readings GROUP BY note", "SELECT note, CAST(sum(cents) * 2 + count(*) AS BIGINT) AS a, max(machine + device) AS b FROM readings GROUP BY note")
selected("a08_bare_first", "SELECT machine, temp, time AS first, COUNT(*) AS n FROM readings GROUP BY machine", "SELECT machine::BIGINT AS machine, arg_min(temp, seq) AS temp, arg_min(time, seq) AS first, count(*) AS n FROM readings GROUP BY machine")
selected("a09_having_alias", "SELECT device, SUM(cents) AS s FROM readings GROUP BY device HAVING s > 500000 AND COUNT(*) > 3", "SELECT device, CAST(sum(cents) AS BIGINT) AS s FROM readings GROUP BY device HAVING sum(cents) > 500000 AND count(*) > 3")


@query("a11_window_stats", READINGS + f"SELECT count(*) AS n, min(temp) AS min, max(temp) AS max, arg_min(time, seq) AS first_time, arg_max(time, seq) AS last_time, round(avg(temp), 4) AS avg FROM readings WHERE time >= {T1}")
def a11_window_stats(spark, sf_dir):
    out = timeseries.trailing_stats(readings(spark, sf_dir), "time", "temp", T1, "seq")
    return out.select("n", "min", "max", "first_time", "last_time", F.round("avg", 4).alias("avg"))


@query("a13_checksum", "SELECT count(*) AS rows, CAST(sum(('0x' || substr(md5('{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || '}'), 1, 15))::BIGINT) AS VARCHAR) AS checksum FROM orders")
def a13_checksum(spark, sf_dir):
    return compare.checksum(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


@query("a15_groups_digest", "SELECT source AS item, count(*) AS rows, sha256(string_agg('f' || chr(9) || source || '/' || doc_id || chr(9) || n_chars || chr(9) || sha256(text), chr(10) ORDER BY source || '/' || doc_id)) AS checksum FROM documents GROUP BY source")
def a15_groups_digest(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    files = d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.lit("f").alias("type"), F.col("n_chars").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return compare.folder_items(files)


@query("w01_trailing", READINGS + "SELECT device, time, seq, count(*) OVER w AS n, min(cents) OVER w AS low, max(cents) OVER w AS high, CAST(sum(cents) OVER w AS BIGINT) AS total FROM readings WINDOW w AS (PARTITION BY device ORDER BY time RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)")
def w01_trailing(spark, sf_dir):
    out = timeseries.trailing_rows(readings(spark, sf_dir), "device", "time", "cents", 86400)
    return out.select("device", "time", "seq", "n", "low", "high", "total")


# -- order

selected("o01_order_nulls", "SELECT 10 / (machine % 3) AS q, seq FROM readings ORDER BY q, seq LIMIT 50", "SELECT CASE WHEN machine % 3 = 0 THEN NULL ELSE (10 // (machine % 3))::BIGINT END AS q, seq FROM readings ORDER BY q NULLS FIRST, seq LIMIT 50")
selected("o02_limit_offset", "SELECT seq, temp FROM readings ORDER BY seq LIMIT 20 OFFSET 30", "SELECT seq, temp FROM readings ORDER BY seq LIMIT 20 OFFSET 30")
selected("o03_topn", "SELECT time, temp, seq FROM readings ORDER BY temp DESC, seq LIMIT 5", "SELECT time, temp, seq FROM readings ORDER BY temp DESC, seq LIMIT 5")
selected("o04_order_constant", "SELECT seq FROM readings ORDER BY 99, seq LIMIT 5", "SELECT seq FROM readings ORDER BY seq LIMIT 5")

# -- functions

selected("f01_arithmetic", "SELECT seq, cents + machine AS a, cents - 7 AS b, cents * machine AS c, temp + 1 AS d FROM readings", "SELECT seq, cents + machine AS a, cents - 7 AS b, cents * machine AS c, temp + 1 AS d FROM readings")
selected("f01_promote", "SELECT seq, 9223372036854775807 - machine + 10 AS a FROM readings", "SELECT seq, CASE WHEN machine < 10 THEN 9223372036854775807::DOUBLE - machine + 10 ELSE CAST(9223372036854775807 - machine + 10 AS DOUBLE) END AS a FROM readings", promote=True)
selected("f02_divide", "SELECT seq, (cents - 20000) / machine AS a, temp / machine AS b FROM readings", "SELECT seq, CASE WHEN machine = 0 THEN NULL ELSE (cents - 20000) // machine END AS a, CASE WHEN machine = 0 THEN NULL ELSE temp / machine END AS b FROM readings")
selected("f03_modulo", "SELECT seq, (cents - 20000) % machine AS a, ROUND(temp % 7.0, 6) AS b FROM readings", "SELECT seq, CASE WHEN machine = 0 THEN NULL ELSE (cents - 20000) % machine END AS a, trunc((temp - trunc(temp / 7.0::DOUBLE) * 7.0::DOUBLE) * 1e6 + 0.5) / 1e6 AS b FROM readings")
selected("f04_negate", "SELECT seq, -temp AS a, -(cents) AS b, -note AS c FROM readings", "SELECT seq, -temp AS a, -cents AS b, CAST(NULL AS BIGINT) AS c FROM readings")
selected("f05_abs", "SELECT seq, ABS(cents - 20000) AS a, ABS(temp - 200) AS b, ABS(note) AS c FROM readings", "SELECT seq, abs(cents - 20000) AS a, abs(temp - 200) AS b, CAST(NULL AS BIGINT) AS c FROM readings")
selected("f06_round", "SELECT seq, ROUND(temp, 1) AS a, ROUND(temp) AS b, ROUND(1.005, 2) AS c FROM readings", "SELECT seq, trunc(temp * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS a, trunc(temp + 0.5) AS b, 1.0::DOUBLE AS c FROM readings")
selected("f07_length", "SELECT doc_id, LENGTH(text) AS bytes, LENGTH(n_chars) AS digits FROM documents", "SELECT doc_id, strlen(text) AS bytes, length(CAST(n_chars AS VARCHAR)) AS digits FROM documents", "documents", ("doc_id",))
selected("f08_case", "SELECT doc_id, LOWER(text) AS low, UPPER(lang) AS up, UPPER(doc_id) AS same FROM documents", "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, translate(lang, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, doc_id AS same FROM documents", "documents", ("doc_id",))


@query("f10_bucket", READINGS + "SELECT time // 60 AS minute, count(*) AS n FROM readings GROUP BY 1")
def f10_bucket(spark, sf_dir):
    return readings(spark, sf_dir).groupBy(S.bucket(F.col("time"), 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


# -- changes, through the store

def customers(spark: SparkSession, sf_dir: str) -> Engine:
    e = scratch(spark)
    e.create_table("c", [("id", "int"), ("nation", "int"), ("segment", "text"), ("cents", "long")], ["id"])
    e.table("c").insert(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents")))
    return e


def changed(name: str, text: str, sql: str) -> None:
    """A query that changes the customers' table and reads it whole."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with customers(spark, sf_dir) as e:
            e.execute(text)
            return e.sql("SELECT * FROM c")

    QUERIES[name] = run
    SQL[name] = "WITH c AS (SELECT c_custkey::BIGINT AS id, c_nationkey::BIGINT AS nation, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer) " + sql


changed("d04_insert", "INSERT INTO c VALUES (-1, 3, 'NEW', 5), (-2, 4, 'NEW', 7 / 2)", "SELECT * FROM c UNION ALL SELECT * FROM (VALUES (-1, 3, 'NEW', 5), (-2, 4, 'NEW', 3)) t")
changed("d05_replace", "INSERT OR REPLACE INTO c VALUES (1, 3, 'A', 5), (-2, 4, 'B', 6), (1, 9, 'C', 7)", "SELECT * FROM c WHERE id <> 1 UNION ALL SELECT * FROM (VALUES (1, 9, 'C', 7), (-2, 4, 'B', 6)) t")
changed("d06_update", "UPDATE c SET cents = cents + 100 * nation, segment = UPPER('gold') WHERE cents > 500000", "SELECT id, nation, CASE WHEN cents > 500000 THEN 'GOLD' ELSE segment END AS segment, CASE WHEN cents > 500000 THEN cents + 100 * nation ELSE cents END AS cents FROM c")
changed("d06_key_move", "UPDATE c SET id = id + 1", "SELECT id + 1 AS id, nation, segment, cents FROM c")
changed("d07_delete", "DELETE FROM c WHERE nation IN (1, 2) OR cents < 0", "SELECT * FROM c WHERE NOT (nation IN (1, 2) OR cents < 0)")






# -- records and streams

@query("t01_sync_read", READINGS + ", r AS (SELECT device, seq, sum(strlen(note) + 30) OVER (PARTITION BY device ORDER BY seq) AS upto, row_number() OVER (PARTITION BY device ORDER BY seq) AS nth FROM readings WHERE seq > 100) SELECT device, seq FROM r WHERE upto <= 500 OR nth = 1")
def t01_sync_read(spark, sf_dir):
    size = F.octet_length("note") + 30
    return records.read_batch(readings(spark, sf_dir), "device", "seq", size, F.lit(100), 500).select("device", "seq")




@query("t04_positions", READINGS + "SELECT device, max(seq) AS last_seq FROM readings GROUP BY device")
def t04_positions(spark, sf_dir):
    return records.positions(readings(spark, sf_dir), "device", "seq")


@query("t06_kv_routing", READINGS + "SELECT device, note AS key, arg_max(temp, seq) AS value FROM readings GROUP BY device, note HAVING arg_max(machine, seq) % 3 <> 0")
def t06_kv_routing(spark, sf_dir):
    r = readings(spark, sf_dir).withColumnRenamed("note", "key")
    return records.last_write_wins(r, ["device", "key"], "temp", "seq", F.col("machine") % 3 == 0)




@query("t08_retention", READINGS + ", last AS (SELECT note AS key, max(seq) AS seq FROM readings WHERE machine < 8 GROUP BY note) SELECT seq FROM (SELECT seq FROM readings WHERE machine >= 8 ORDER BY seq DESC LIMIT 500) UNION ALL SELECT last.seq FROM last JOIN readings USING (seq) WHERE machine < 4 OR last.seq > 2000")
def t08_retention(spark, sf_dir):
    r = readings(spark, sf_dir).withColumnRenamed("note", "key")
    kind = F.when(F.col("machine") < 4, "PUT").when(F.col("machine") < 8, "DEL").otherwise("ROW")
    return records.retain(r, "seq", kind, 500, 2000).select("seq")




@query("t10_excursions", READINGS + ", h AS (SELECT *, temp > 40 AS high, lag(temp > 40) OVER (PARTITION BY device ORDER BY time) AS before FROM readings), r AS (SELECT *, sum(CASE WHEN high AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM h) SELECT device, min(time) AS start, max(time) AS end, max(temp) AS peak FROM r WHERE high GROUP BY device, run HAVING max(time) - min(time) >= 3600")
def t10_excursions(spark, sf_dir):
    return timeseries.excursions(readings(spark, sf_dir), "device", "time", "temp", 40, 3600, "seq")


@query("t11_minutes", READINGS + "SELECT time // 900 * 900 AS start, min(temp) AS low, max(temp) AS high, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM readings GROUP BY 1")
def t11_minutes(spark, sf_dir):
    r = readings(spark, sf_dir)
    out = r.groupBy((S.bucket(F.col("time"), 900) * 900).alias("start")).agg(F.min("temp").alias("low"), F.max("temp").alias("high"), F.count("temp").alias("n"), F.sum("cents").alias("total"))
    return out


# -- verification

ITEMS = "now AS (SELECT l_returnflag AS item, count(*) AS rows FROM lineitem GROUP BY 1), base AS (SELECT l_linestatus AS item, count(*) AS previous FROM lineitem GROUP BY 1)"


def items(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col(column).alias("item")).agg(F.count(F.lit(1)).alias("rows")).withColumn("checksum", F.col("rows").cast("string"))


@query("j04_compare", f"WITH {ITEMS} SELECT coalesce(now.item, base.item) AS item, rows, previous, CASE WHEN rows IS NULL THEN 'gone' WHEN previous IS NULL THEN 'new' WHEN rows < previous * 0.95 THEN 'shrank' WHEN rows = previous THEN 'same' ELSE 'changed' END AS change FROM now FULL JOIN base ON now.item = base.item")
def j04_compare(spark, sf_dir):
    return compare.changes(items(spark, sf_dir, "l_returnflag"), items(spark, sf_dir, "l_linestatus"))




@query("r03_verdict", f"WITH {ITEMS}, c AS (SELECT CASE WHEN rows IS NULL THEN 1 WHEN previous IS NOT NULL AND rows < previous * 0.95 THEN 1 ELSE 0 END AS bad, CASE WHEN rows IS NULL THEN 0 ELSE 1 END AS here FROM now FULL JOIN base ON now.item = base.item) SELECT CASE WHEN sum(bad) > 0 OR sum(here) = 0 THEN 'ALERT' ELSE 'PASSED' END AS verdict, CAST(sum(bad) AS BIGINT) AS alerts, CAST(sum(here) AS BIGINT) AS items FROM c")
def r03_verdict(spark, sf_dir):
    return compare.verdict(compare.changes(items(spark, sf_dir, "l_returnflag"), items(spark, sf_dir, "l_linestatus")))


# -- through an engine's tables, buckets and statements

def fleet(spark: SparkSession, sf_dir: str) -> Engine:
    """Readings in a table keyed (machine, time, seq) with two indexes; temp is a FLOAT."""
    e = scratch(spark)
    e.execute("CREATE TABLE m (machine INT, time TIME, seq LONG, device LONG, temp FLOAT, note TEXT, PRIMARY KEY (machine, time, seq)); CREATE INDEX m_temp ON m (temp, machine); CREATE INDEX m_device ON m (device)")
    e.table("m").insert(readings(spark, sf_dir).select("machine", "time", "seq", "device", "temp", "note"))
    return e


def on_fleet(name: str, text: str, sql: str | None = None) -> None:
    """A SELECT over the fleet's table, by the access path the engine picks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with fleet(spark, sf_dir) as e:
            return e.sql(text)

    QUERIES[name] = run
    SQL[name] = READINGS + ", m AS (SELECT machine::BIGINT AS machine, * EXCLUDE (machine, temp), CAST(CAST(CAST(temp AS FLOAT) AS VARCHAR) AS DOUBLE) AS temp FROM readings) " + (sql or text)


on_fleet("s11_index_order", "SELECT temp, time, seq FROM m WHERE device = 7 ORDER BY temp, time, seq LIMIT 20")
on_fleet("s12_plan_point", "SELECT machine, time, seq, temp FROM m WHERE machine = 3 AND time = 1704153600 AND seq >= 0 OR machine = 99", "SELECT machine, time, seq, temp FROM m WHERE machine = 3 AND time = 1704153600")
on_fleet("s13_plan_range", f"SELECT time, temp FROM m WHERE machine = 3 AND time >= {T0} AND time < {T1}")
on_fleet("s14_plan_list", f"SELECT machine, time, temp FROM m WHERE machine IN (1, 5, 5, -3) AND time > {T0}")
on_fleet("s16_plan_index", "SELECT time, temp FROM m WHERE temp BETWEEN 25.5 AND 26.5 AND machine = 6", "SELECT time, temp FROM m WHERE temp BETWEEN 25.5::DOUBLE AND 26.5::DOUBLE AND machine = 6")


@query("s09_point", "SELECT c_custkey::BIGINT AS id, c_nationkey::BIGINT AS nation FROM customer WHERE c_custkey IN (3, 33)")
def s09_point(spark, sf_dir):
    with customers(spark, sf_dir) as e:
        rows = [r for k in (3, 33, -9) if (r := e.table("c").get(k))]
        return spark.createDataFrame([(r["id"], r["nation"]) for r in rows], "id long, nation long")


@query("s10_prefix", READINGS + "SELECT time, seq, note FROM readings WHERE machine = 7")
def s10_prefix(spark, sf_dir):
    with fleet(spark, sf_dir) as e:
        return e.table("m").prefix(7).select("time", "seq", "note")


@query("s11_index_seek", READINGS + "SELECT device, time, seq FROM readings WHERE device = 9")
def s11_index_seek(spark, sf_dir):
    with fleet(spark, sf_dir) as e:
        return e.table("m").index("m_device").prefix(9).select("device", "time", "seq")


def nation_kv(spark: SparkSession, sf_dir: str) -> Engine:
    """Names and regions of nations as pairs; those of region 2 deleted again, one written twice."""
    e = scratch(spark)
    rows = read(spark, sf_dir, "nation").collect()  # 25 rows
    e.kv.put_all([(r["n_name"], r["n_regionkey"]) for r in rows])
    e.execute("INSERT INTO kv VALUES ('NATION_6', 'twice')")
    for r in rows:
        if r["n_regionkey"] == 2 and r["n_nationkey"] % 2:
            e.kv.delete(r["n_name"])
    return e


@query("s04_point_get", "SELECT n_name AS key, CASE WHEN n_name = 'NATION_6' THEN 'twice' ELSE n_regionkey::VARCHAR END AS value FROM nation WHERE n_name IN ('NATION_6', 'NATION_18')")
def s04_point_get(spark, sf_dir):
    with nation_kv(spark, sf_dir) as e:
        return spark.createDataFrame([(k, v) for k in ("NATION_6", "NATION_18", "nowhere") if (v := e.kv.get(k)) is not None], "key string, value string")


@query("s05_put_delete", "SELECT n_name AS key, CASE WHEN n_name = 'NATION_6' THEN 'twice' ELSE n_regionkey::VARCHAR END AS value FROM nation WHERE NOT (n_regionkey = 2 AND n_nationkey % 2 = 1)")
def s05_put_delete(spark, sf_dir):
    with nation_kv(spark, sf_dir) as e:
        return e.sql("SELECT key, value FROM kv")


def supplier_bucket(spark: SparkSession, sf_dir: str):
    """Suppliers by their numbers as four bytes, highest first."""
    e = scratch(spark)
    b = e.bucket("suppliers")
    b.put_all([(r["s_suppkey"].to_bytes(4, "big"), r["s_name"].encode()) for r in read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").toLocalIterator()])
    return e, b


@query("s06_buckets", "SELECT * FROM (VALUES ('suppliers', true), ('others', false)) t(name, there)")
def s06_buckets(spark, sf_dir):
    e, _ = supplier_bucket(spark, sf_dir)
    with e:
        rows = []
        for name in ("suppliers", "others"):
            try:
                rows.append((name, bool(e.bucket(name, create=False))))
            except EngineError:
                rows.append((name, False))
        return spark.createDataFrame(rows, "name string, there boolean")


@query("s07_bucket_direct", "SELECT s_suppkey AS k, CASE WHEN s_suppkey = 4 THEN 'new' ELSE s_name END AS v FROM supplier WHERE s_suppkey <> 3")
def s07_bucket_direct(spark, sf_dir):
    e, b = supplier_bucket(spark, sf_dir)
    with e:
        b.put((4).to_bytes(4, "big"), b"new")
        b.delete((3).to_bytes(4, "big"))
        return b.df().select(F.conv(F.hex("k"), 16, 10).cast("bigint").alias("k"), F.col("v").cast("string").alias("v"))


@query("s08_cursor", "SELECT * FROM (SELECT 'seek' AS move, min(s_suppkey) AS k FROM supplier WHERE s_suppkey >= 5 UNION ALL SELECT 'next', min(s_suppkey) FROM supplier WHERE s_suppkey > 5 UNION ALL SELECT 'prev', max(s_suppkey) FROM supplier WHERE s_suppkey < 5 UNION ALL SELECT 'last', max(s_suppkey) FROM supplier)")
def s08_cursor(spark, sf_dir):
    e, b = supplier_bucket(spark, sf_dir)
    with e:
        at = (5).to_bytes(4, "big")
        found = {"seek": b.seek(at), "next": b.next(at), "prev": b.prev(at), "last": b.last()}
        return spark.createDataFrame([(m, int.from_bytes(x[0], "big")) for m, x in found.items()], "move string, k long")


@query("s20_export", "SELECT 'row r ' || c_custkey || ' ' || c_nationkey || ' \"' || c_mktsegment || '\"' AS line FROM customer")
def s20_export(spark, sf_dir):
    with scratch(spark) as e:
        e.series.create("r", "time:time,n:int,s:text")
        e.series.append("r", read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("time"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")))
        return textio.lines(e).where("part > 1").select("line")


@query("s21_import", "SELECT s_suppkey AS time, s_nationkey::BIGINT AS n, s_name AS s FROM supplier")
def s21_import(spark, sf_dir):
    with scratch(spark) as a, scratch(spark) as b:
        a.series.create("r", "time:time,n:int,s:text")
        a.series.append("r", read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("time"), F.col("s_nationkey").alias("n"), F.col("s_name").alias("s")))
        textio.import_(b, textio.export(a))
        return b.table("r").df()


REFUSED = {"nesting": "SELECT " + "(" * 250 + "1" + ")" * 250, "join": "SELECT * FROM c, d", "union": "SELECT 1 UNION SELECT 2", "subquery": "SELECT id FROM c WHERE id IN (SELECT 1)", "aggregate in WHERE": "SELECT id FROM c WHERE COUNT(*) > 1", "DISTINCT aggregate": "SELECT COUNT(DISTINCT id) FROM c", "unknown function": "SELECT SUBSTR(segment, 1) FROM c", "unknown column": "SELECT nothing FROM c", "NULL": "INSERT INTO c VALUES (NULL, 1, 'x', 2)", "key": "INSERT INTO c VALUES (1, 1, 'x', 2)"}


@query("p13_refused", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in {"nesting": "SyntaxError", "join": "SyntaxError", "union": "SyntaxError", "subquery": "SyntaxError", "aggregate in WHERE": "SyntaxError", "DISTINCT aggregate": "SyntaxError", "unknown function": "SyntaxError", "unknown column": "SchemaError", "NULL": "SchemaError", "key": "ExistsError"}.items()) + ") t(what, error)")
def p13_refused(spark, sf_dir):
    """What the language refuses, and that nothing of it changes the table."""
    with customers(spark, sf_dir) as e:
        rows, before = [], e.store.state["version"]
        for what, text in REFUSED.items():
            try:
                e.execute(text)
                rows.append((what, "none"))
            except EngineError as error:
                rows.append((what, type(error).__name__))
        if e.store.state["version"] != before:
            raise CorruptError("a refused statement left a trace")
        return spark.createDataFrame(rows, "what string, error string")


@query("a14_ordered_checksum", "SELECT count(*) AS rows, true AS same, false AS shuffled FROM orders")
def a14_ordered_checksum(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n, one = compare.ordered_checksum(o, ["o_orderkey"])
    same = compare.ordered_checksum(o.repartition(7), ["o_orderkey"])[1] == one
    return spark.createDataFrame([(n, same, compare.ordered_checksum(o, ["o_custkey"])[1] == one)], "rows long, same boolean, shuffled boolean")


@query("d02_drop", "SELECT * FROM (VALUES ('b', 'x:int,y:text', 'x', 'table', 'by')) t(name, columns, key, kind, indexes)")
def d02_drop(spark, sf_dir):
    with scratch(spark) as e:
        e.execute("CREATE TABLE a (x INT); CREATE TABLE IF NOT EXISTS a (z INT); CREATE TABLE b (x INT PRIMARY KEY, y TEXT); CREATE INDEX by ON b (y); CREATE INDEX bx ON b (y, x); DROP INDEX bx; DROP TABLE a; DROP TABLE IF EXISTS a")
        return e.tables()


@query("d08_rows", "SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_nationkey END::BIGINT AS nation FROM customer WHERE c_custkey <> 7")
def d08_rows(spark, sf_dir):
    with customers(spark, sf_dir) as e:
        t = e.table("c")
        t.upsert(t.df().where("id % 10 = 0").withColumn("nation", F.lit(0)))
        t.delete(7)
        return t.df().select("id", "nation")


@query("d09_coercion", "SELECT p_partkey::BIGINT AS id, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(CAST(CAST(p_retailprice AS FLOAT) AS VARCHAR) AS DOUBLE) AS f FROM part")
def d09_coercion(spark, sf_dir):
    with scratch(spark) as e:
        e.create_table("p", [("id", "int"), ("whole", "long"), ("f", "float")], ["id"])
        price = F.col("p_retailprice").cast("double")
        e.table("p").insert(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), price.alias("whole"), price.alias("f")))
        return e.sql("SELECT id, whole, f FROM p")


def failing(e: Engine, text: str) -> None:
    """Run a statement that has to fail."""
    try:
        e.execute(text)
    except (ExistsError, SchemaError):
        return
    raise CorruptError("the statement should have failed")


CUSTOMERS = "WITH c AS (SELECT c_custkey::BIGINT AS id, c_nationkey::BIGINT AS nation, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer) "


@query("d10_rollback", CUSTOMERS + "SELECT * FROM c WHERE id <> 5")
def d10_rollback(spark, sf_dir):
    with customers(spark, sf_dir) as e:
        e.begin()
        e.execute("DELETE FROM c; INSERT INTO c VALUES (1, 1, 'x', 1)")
        e.rollback()
        with e.transaction():
            e.execute("DELETE FROM c WHERE id = 5")
        return e.sql("SELECT * FROM c")


@query("d11_savepoint", CUSTOMERS + "SELECT id, nation, segment, CASE WHEN id = 1 THEN 0 ELSE cents END AS cents FROM c WHERE id <> 2")
def d11_savepoint(spark, sf_dir):
    """Statements of one transaction, two of which fail half-way and leave nothing."""
    with customers(spark, sf_dir) as e:
        with e.transaction():
            e.execute("UPDATE c SET cents = 0 WHERE id = 1")
            failing(e, "INSERT INTO c VALUES (-1, 1, 'x', 1), (3, 1, 'x', 1)")
            failing(e, "UPDATE c SET nation = nation + 2147483647")
            e.execute("DELETE FROM c WHERE id = 2")
        return e.sql("SELECT * FROM c")


@query("d12_explain", "SELECT * FROM (VALUES ('point lookup', 'c, fixed: id'), ('key list', 'c, list on id (3 values)'), ('index range', 'c, index c_ns, fixed: nation'), ('full scan', 'c')) t(plan, detail)")
def d12_explain(spark, sf_dir):
    with customers(spark, sf_dir) as e:
        e.execute("CREATE INDEX c_ns ON c (nation, segment)")
        rows = [tuple(e.explain(f"SELECT * FROM c WHERE {w}")) for w in ("id = 5", "id IN (1, 2, 3)", "nation = 3", "segment LIKE 'x%'")]
        return spark.createDataFrame([(plan, told.split("; ")[0]) for plan, told in rows], "plan string, detail string")


@query("d13_prepared", CUSTOMERS + "SELECT id, 7 AS n FROM c WHERE nation = 7 AND cents > 100000 UNION ALL SELECT id, 8 FROM c WHERE nation = 8 AND cents > -5000")
def d13_prepared(spark, sf_dir):
    with customers(spark, sf_dir) as e:
        s = e.prepare("SELECT id FROM c WHERE nation = ? AND cents > ?")
        return s.run(7, 100_000).withColumn("n", F.lit(7)).unionByName(s.run(8, -5000).withColumn("n", F.lit(8)))


@query("d15_check", "SELECT * FROM (VALUES ('before', 0), ('after', 1)) t(what, n)")
def d15_check(spark, sf_dir):
    """The checker on a sound table with an index, and after a data file was lost."""
    with customers(spark, sf_dir) as e:
        e.execute("CREATE UNIQUE INDEX c_u ON c (id, nation)")
        before = len(e.check())
        e.store.files.delete(f"{e.store.root}/{e.describe('c').entry['files'][0]}")
        return spark.createDataFrame([("before", before), ("after", len(e.check()))], "what string, n int")


@query("j05_index_faults", "SELECT 'entry without a row' AS fault, (SELECT count(*) FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 70 <> 0) AS n UNION ALL SELECT 'row without an entry', (SELECT count(*) FROM customer WHERE c_custkey % 70 = 0 AND c_custkey % 50 <> 0)")
def j05_index_faults(spark, sf_dir):
    """A stored index with some entries taken away, against its table with some rows taken away."""
    with customers(spark, sf_dir) as e:
        e.execute("CREATE INDEX c_n ON c (nation)")
        t = e.describe("c")
        entries, rows = e.store.entries(t, "c_n").where("id % 70 <> 0"), e.store.rows(t).where("id % 50 <> 0")
        return compare.index_faults(entries.select("nation", "id"), rows.select("nation", "id"), ["nation", "id"])


# -- devices: logs of real records, in two batches a device

#: Of each device: (time, temp, note) as records 2 and on, after the definition of their series. Every fifth
#: device's second batch starts past a gap, every seventh's last record is damaged.
LOG = READINGS + ", log AS (SELECT *, 1 + row_number() OVER (PARTITION BY device ORDER BY seq) AS rec, 1 + count(*) OVER (PARTITION BY device) AS n FROM readings), pos AS (SELECT device, any_value(n) AS n, CASE WHEN device % 5 = 0 THEN (any_value(n) + 1) // 2 WHEN device % 7 = 0 THEN any_value(n) - 1 ELSE any_value(n) END AS last FROM log GROUP BY device) "
SENT = [ColumnDef("time", "time"), ColumnDef("temp", "float"), ColumnDef("note", "text")]


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(pdf):
        import pandas as pd

        device, rows = int(pdf["device"].iloc[0]), pdf.sort_values("seq")
        records = [encode(series_record(1, 4, "temps", "time:time,temp:float,note:text"))]
        records += [encode(Record(i, ROW, value=pack_row(SENT, (int(t), x, s)), series=4)) for i, (t, x, s) in enumerate(zip(rows["time"], rows["temp"], rows["note"], strict=True), 2)]
        half = (len(records) + 1) // 2
        late = b"".join(records[half:])
        if device % 7 == 0 and device % 5:
            late = late[:-1] + bytes([late[-1] ^ 1])
        return pd.DataFrame({"device": [device] * 2, "after_seq": [0, half + (9 if device % 5 == 0 else 0)], "payload": [b"".join(records[:half]), late]})

    return readings(spark, sf_dir).select("device", "seq", "time", "temp", "note").groupBy("device").applyInPandas(run, BATCH)


def synced(spark: SparkSession, sf_dir: str) -> tuple[Engine, DataFrame]:
    e = scratch(spark)
    return e, Gateway(e).apply_all(logs(spark, sf_dir))


@query("t02_apply", LOG + "SELECT device, rec AS seq, time, CAST(CAST(CAST(temp AS FLOAT) AS VARCHAR) AS DOUBLE) AS temp, note FROM log JOIN pos USING (device) WHERE rec <= last")
def t02_apply(spark, sf_dir):
    e, _ = synced(spark, sf_dir)
    with e:
        return e.sql("SELECT * FROM temps")


@query("t03_gaps", LOG + "SELECT device, 'OK' AS status, (n + 1) // 2 AS seq FROM pos UNION ALL SELECT device, CASE WHEN device % 5 = 0 THEN 'GAP' WHEN device % 7 = 0 THEN 'CORRUPT' ELSE 'OK' END, last FROM pos")
def t03_gaps(spark, sf_dir):
    e, verdicts = synced(spark, sf_dir)
    with e:
        return verdicts


@query("t05_series", "SELECT device, 4::BIGINT AS series, 'temps' AS name FROM (SELECT DISTINCT user_id AS device FROM events)")
def t05_series(spark, sf_dir):
    e, _ = synced(spark, sf_dir)
    with e:
        return e.table("_series").df()


@query("t07_crc", LOG + "SELECT device, CASE WHEN device % 5 <> 0 AND device % 7 = 0 THEN last ELSE n END AS good, device % 5 <> 0 AND device % 7 = 0 AS broken FROM pos")
def t07_crc(spark, sf_dir):
    """Records of real batches decoded until their checksums end them."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for device, payload in zip(b["device"], b["payload"], strict=True):
                n, broken = 0, False
                try:
                    for _ in decode(bytes(payload)):
                        n += 1
                except CorruptError:
                    broken = True
                out.append((device, n, broken))
            yield pd.DataFrame(out, columns=["device", "n", "broken"])

    found = logs(spark, sf_dir).select("device", "payload").mapInPandas(run, "device long, n long, broken boolean")
    return found.groupBy("device").agg(F.sum("n").alias("good"), F.max("broken").alias("broken"))


@query("s15_plan_devices", LOG + f"SELECT device, count(*) AS n FROM log JOIN pos USING (device) WHERE rec <= last AND time >= {T0} GROUP BY device")
def s15_plan_devices(spark, sf_dir):
    e, _ = synced(spark, sf_dir)
    with e:
        return e.sql(f"SELECT device, COUNT(*) AS n FROM temps WHERE time >= {T0} GROUP BY device")


@query("t09_rule", READINGS + ", w AS (SELECT device, time, seq, sum(cents) OVER v AS total, count(*) OVER v AS n FROM readings WINDOW v AS (PARTITION BY device ORDER BY time RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)), c AS (SELECT *, CASE WHEN total > 6000 * n THEN 1 WHEN total < 3000 * n THEN 0 END AS change FROM w) SELECT device, time, seq, CAST(coalesce(last_value(change IGNORE NULLS) OVER (PARTITION BY device ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS active FROM c")
def t09_rule(spark, sf_dir):
    """On when the mean of the last day is over 60, off when it is under 30."""
    w = timeseries.trailing_rows(readings(spark, sf_dir), "device", "time", "cents", 86400)
    return timeseries.hysteresis(w, "device", "time", F.col("total") > 6000 * F.col("n"), F.col("total") < 3000 * F.col("n")).select("device", "time", "seq", "active")


@query("r02_baseline", "SELECT * FROM (VALUES (1, 'PASSED'), (2, 'ALERT'), (3, 'ACCEPTED'), (4, 'PASSED')) t(run, verdict)")
def r02_baseline(spark, sf_dir):
    """Runs of one job: a baseline, a shrunken backup against it, the same accepted, the same again."""
    with scratch(spark) as e:
        v, whole = Verifier(e), items(spark, sf_dir, "l_returnflag")
        less = whole.withColumn("rows", F.col("rows") - F.ceil(F.col("rows") / 5))
        runs = [v.verify("job", items=whole, at=1), v.verify("job", items=less, at=2), v.verify("job", items=less, accept=True, at=3), v.verify("job", items=less, at=4)]
        return spark.createDataFrame([(r.run, r.verdict) for r in runs], "run int, verdict string")


@query("r04_history", "SELECT 'job' AS job, 1::BIGINT AS run, l_returnflag AS item, count(*) AS rows FROM lineitem GROUP BY l_returnflag")
def r04_history(spark, sf_dir):
    with scratch(spark) as e:
        Verifier(e).verify("job", items=items(spark, sf_dir, "l_returnflag"), at=1)
        return e.sql("SELECT job, run, item, rows FROM counts")


@query("r06_seal", "SELECT true AS sound, false AS changed, false AS without_key")
def r06_seal(spark, sf_dir):
    with scratch(spark) as e:
        r = Verifier(e).verify("job", items=items(spark, sf_dir, "l_returnflag"), key=b"key", signer="ann", at=1).report
        return spark.createDataFrame([(check_seal(r, b"key"), check_seal(r.replace("ann", "eve"), b"key"), check_seal(r))], "sound boolean, changed boolean, without_key boolean")
