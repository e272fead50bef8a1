"""One query per operator on the given tables, each with its SQL counterpart where SQL can say it.

The flow tables of the domain are views of `events` (flows: key, family, bytes, packets ...), `embeddings` (logits,
client updates), `lineitem` (wide numeric rows) and `orders` (run metrics).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import calibrate, evidence, features, federated, labels, metrics, posthoc, profile, report, sampling, train
from ..sources import csv_scan, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- views ---------------------------------------------------------------------------------------------------------

FLOWS = """flows AS (
  SELECT event_id AS key, CASE WHEN event_type = 'view' THEN 'benign' ELSE event_type END AS family,
    CASE WHEN k < 80 THEN 'benign' WHEN k < 95 THEN 'dos' WHEN k < 99 THEN 'recon' ELSE 'rare' END AS skewed,
    user_id, k, value AS in_bytes, value * (k % 7) AS out_bytes, k AS in_pkts, k % 13 AS out_pkts, value * k AS duration,
    k % 32 AS flags, CASE k % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS protocol, event_id % 4096 AS src_port, event_id % 1500 AS dst_port
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as NetFlow-like rows; `family` is balanced, `skewed` is not."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", k)
    return e.select(
        F.col("event_id").alias("key"), F.when(F.col("event_type") == "view", "benign").otherwise(F.col("event_type")).alias("family"), F.when(F.col("k") < 80, "benign").when(F.col("k") < 95, "dos").when(F.col("k") < 99, "recon").otherwise("rare").alias("skewed"),
        "user_id", "k", F.col("value").alias("IN_BYTES"), (F.col("value") * (F.col("k") % 7)).alias("OUT_BYTES"), F.col("k").alias("IN_PKTS"), (F.col("k") % 13).alias("OUT_PKTS"), (F.col("value") * F.col("k")).alias("FLOW_DURATION_MILLISECONDS"),
        (F.col("k") % 32).alias("TCP_FLAGS"), F.when(F.col("k") % 3 == 0, 6).when(F.col("k") % 3 == 1, 17).otherwise(1).alias("PROTOCOL"), (F.col("event_id") % 4096).alias("L4_SRC_PORT"), (F.col("event_id") % 1500).alias("L4_DST_PORT"),
    )


#: Rank and group size by which a split or cap of the flows is decided in SQL.
def ranked_sql(salt: str, family: str = "family", seed: int = 42, source: str = "flows") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY md5(concat_ws('|', '{seed}', '{salt}', CAST(key AS VARCHAR))), key) AS r, count(*) OVER (PARTITION BY {family}) AS n FROM {source}"


QUOTA = "CASE WHEN n <= 2 THEN 0 ELSE greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT)) END"
SPLIT = f"{FLOWS}, split AS (SELECT *, CASE WHEN r <= {QUOTA} THEN 'test' ELSE 'train' END AS split FROM ({ranked_sql('split')}))"

LOGITS = """s0 AS (SELECT vec_id AS key, CAST(label AS INTEGER) AS y, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE) * 8) AS logits, CAST(embedding[11] AS DOUBLE) AS gate FROM embeddings),
s1 AS (SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits))) AS e FROM s0),
s2 AS (SELECT *, list_transform(e, lambda v: v / list_sum(e)) AS probs FROM s1),
scored AS (SELECT key, y, logits, gate, probs, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS pred, list_max(probs) AS confidence FROM s2)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("key"), F.col("label").cast("int").alias("y"), F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double") * 8).alias("logits"), F.col("embedding")[10].cast("double").alias("gate"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_logits(logits(spark, sf_dir))


UPDATES = """updates AS (SELECT CAST(vec_id % 10 AS INTEGER) AS client, CAST(i - 1 AS INTEGER) AS coord, avg(CAST(embedding[i] AS DOUBLE)) AS value, count(*) AS n
  FROM embeddings, range(1, 65) t(i) GROUP BY ALL)"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") % 10).cast("int").alias("client"), F.posexplode("embedding").alias("coord", "v"))
    return e.groupBy("client", F.col("coord").cast("int").alias("coord")).agg(F.avg(F.col("v").cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))


RUNS = """runs AS (SELECT n_name AS dataset, CASE o_orderpriority WHEN '1-URGENT' THEN 'traffic_only' WHEN '2-HIGH' THEN 'weak_cti' WHEN '3-MEDIUM' THEN 'source_gate' ELSE 'random_cti' END AS scenario,
    CAST(42 + o_orderkey % 3 AS INTEGER) AS seed, avg(o_totalprice) / 1e6 AS macro_f1, avg(o_totalprice % 1000) / 1e3 AS ece, stddev_pop(o_totalprice) / 1e6 AS brier, count(*) AS rows_n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
SCENARIOS = ["traffic_only", "weak_cti", "source_gate", "random_cti"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metrics by dataset (nation), scenario (priority) and seed."""
    o, c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    scenario = F.when(F.col("o_orderpriority") == "1-URGENT", "traffic_only").when(F.col("o_orderpriority") == "2-HIGH", "weak_cti").when(F.col("o_orderpriority") == "3-MEDIUM", "source_gate").otherwise("random_cti")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("dataset"), scenario.alias("scenario"), (42 + F.col("o_orderkey") % 3).cast("int").alias("seed")).agg(
        (F.avg("o_totalprice") / 1e6).alias("macro_f1"), (F.avg(F.col("o_totalprice") % 1000) / 1e3).alias("ece"), (F.stddev_pop("o_totalprice") / 1e6).alias("brier"), F.count(F.lit(1)).alias("rows_n")
    )


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) + 0.0 for c in columns})


# ---- sources and sinks ---------------------------------------------------------------------------------------------


@query("s1_read_table", "SELECT p_partkey, p_brand, p_type FROM part")
def s1(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/part.parquet", "p_type").select("p_partkey", "p_brand", "p_type")


def _csv_copy(spark, sf_dir: str) -> str:
    """orders as CSV parts in the shared folder, so that the CSV readers have something that the tables say."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root}/orders-csv-{uuid.uuid4().hex}"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    tables.write_metrics(df.withColumn("part", F.col("o_orderkey") % 4), path, ("part",), "csv")
    return path


@query("s2_s8_csv_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def s2(spark, sf_dir):
    df = tables.read_csv_files(spark, _csv_copy(spark, sf_dir))
    return df.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", X.to_double(F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority")


_SCANNED = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("s3_a25_tolerant_scan", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad, count(o_totalprice) AS n_filled, 'ok' AS status FROM orders")
def s3(spark, sf_dir):
    scan = csv_scan.scan_csv(spark, _csv_copy(spark, sf_dir), _SCANNED)
    filled = csv_scan.rows_of(scan).groupBy(F.col("_file").alias("file")).agg(F.count("o_totalprice").alias("filled"))
    return csv_scan.report(scan).join(filled, "file", "left").groupBy("status").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"), F.sum("filled").alias("n_filled")).select("n_rows", "n_bad", "n_filled", "status")


def _broken_copy(spark, sf_dir: str) -> str:
    """orders as four folders of CSV parts: sound ones, ones where a row has a cell too many, ones whose body isn't UTF-8,
    and ones under other names."""
    path = _csv_copy(spark, sf_dir) + "-broken"
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*_SCANNED).repartition(4, "o_orderkey")
    write = lambda x, kind, **options: x.write.options(**({"header": True} | options)).csv(f"{path}/{kind}")
    write(df, "sound")
    lines = df.select(F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderkey") % 100 == 0, "more")).alias("o_orderkey,o_orderstatus,o_totalprice,o_orderpriority"))
    write(lines, "unequal", sep="\x01", quote="", emptyValue="")
    write(df.withColumn("o_orderstatus", F.lit("\u00e9")), "latin", encoding="ISO-8859-1")
    write(df.toDF("a", "b", "c", "d"), "renamed")
    return path


@query("s3_a25_broken_files", """SELECT 'sound' AS kind, 'ok' AS status, '' AS error, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad, count(*) AS n_read, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS labels FROM orders
UNION ALL SELECT 'unequal', 'partial', '', count(*) FILTER (o_orderkey % 100 <> 0), count(*) FILTER (o_orderkey % 100 = 0), count(*) FILTER (o_orderkey % 100 <> 0), string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FILTER (o_orderkey % 100 <> 0) FROM orders
UNION ALL SELECT 'latin', 'error', 'UnicodeDecodeError', 0, 0, 0, '' UNION ALL SELECT 'renamed', 'error', 'none of the columns', 0, 0, 0, ''""")  # fmt: skip
def s3_broken(spark, sf_dir):
    scan = csv_scan.scan_csv(spark, _broken_copy(spark, sf_dir), _SCANNED)
    kind = lambda c: F.regexp_extract(c, "-broken/([a-z]+)/", 1)
    told = csv_scan.report(scan, "o_orderstatus").groupBy(kind("file").alias("kind"), "status", F.coalesce(F.substring_index("error", ":", 1), F.lit("")).alias("error"))
    keys = F.flatten(F.collect_set(F.coalesce(F.json_object_keys("labels"), F.array().cast("array<string>"))))
    told = told.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"), F.array_join(F.array_sort(F.array_distinct(keys)), ",").alias("labels"))
    read = csv_scan.rows_of(scan).groupBy(kind("_file").alias("kind")).agg(F.count(F.lit(1)).alias("n_read"))
    return told.join(read, "kind", "left").select("kind", "status", "error", "n_rows", "n_bad", F.coalesce("n_read", F.lit(0)).alias("n_read"), "labels")


@query("s4_bounded_read", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def s4(spark, sf_dir):
    return tables.bounded_read(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@query("s5_blank_to_null", "SELECT key, CASE WHEN k % 10 = 0 THEN NULL ELSE round(in_bytes, 6) END AS x FROM (WITH " + FLOWS + " SELECT * FROM flows)")
def s5(spark, sf_dir):
    text = F.when(F.col("k") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("IN_BYTES").cast("string")))
    return rounded(tables.blank_to_null(flows(spark, sf_dir).select("key", text.alias("x")), ["x"]), "x")


@query("s6_write_metrics", f"WITH {RUNS} SELECT dataset, scenario, seed, round(macro_f1, 6) AS macro_f1, rows_n FROM runs")
def s6(spark, sf_dir):
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root}/metrics-{uuid.uuid4().hex}"
    tables.write_metrics(runs(spark, sf_dir), path)
    return rounded(spark.read.parquet(path).select("dataset", "scenario", F.col("seed").cast("int").alias("seed"), "macro_f1", "rows_n"), "macro_f1")


@query("s7_manifest", f"""WITH {FLOWS}, c AS (SELECT skewed AS family, count(*) AS n FROM flows GROUP BY 1)
SELECT '{{"dataset":"events","rows":' || sum(n) || ',"families":{{' || string_agg('"' || family || '":' || n, ',' ORDER BY family) || '}}}}' AS manifest FROM c""")  # fmt: skip
def s7(spark, sf_dir):
    return tables.manifest_rows(flows(spark, sf_dir).groupBy(F.col("skewed").alias("family")).agg(F.count(F.lit(1)).alias("n")), "events")


# ---- projections and predicates ------------------------------------------------------------------------------------


@query("p1_p2_p3_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def p1_p3(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity", F.col("l_returnflag").alias("Attack_type"), F.col("l_linestatus").alias("IPV4_SRC_ADDR"))
    assert profile.find_label(df.columns) == "Attack_type"
    return profile.drop_identifiers(profile.drop_label_like(df))


LABEL_TEXT = "CASE p_size % 14 WHEN 0 THEN 'DDoS-ICMP_Flood' WHEN 1 THEN 'Mirai-greeth_flood' WHEN 2 THEN 'MITM-ArpSpoofing' WHEN 3 THEN 'DNS_Spoofing' WHEN 4 THEN 'VulnerabilityScan' WHEN 5 THEN 'DictionaryBruteForce' WHEN 6 THEN 'Uploading_Attack' WHEN 7 THEN 'Backdoor_Malware' WHEN 8 THEN ' Normal ' WHEN 9 THEN 'Mirai-udpplain' WHEN 10 THEN 'Port Scan' WHEN 11 THEN 'dos_hulk' WHEN 12 THEN '' ELSE p_type END"
_FAMILY_SQL = """CASE WHEN x IN ('', 'nan', 'none') THEN 'other' WHEN contains(x, 'benign') OR x = 'normal' THEN 'benign'
  WHEN contains(x, 'ddos') OR x LIKE 'dos%' OR contains(x, 'flood') OR contains(x, 'slowloris') THEN 'dos_ddos' WHEN contains(x, 'mirai') THEN 'mirai'
  WHEN contains(x, 'recon') OR contains(x, 'scan') OR contains(x, 'fingerprint') OR contains(x, 'vulnerability') THEN 'recon'
  WHEN contains(x, 'mitm') OR contains(x, 'spoof') THEN 'spoofing_mitm' WHEN contains(x, 'bruteforce') OR contains(x, 'dictionary') OR contains(x, 'password') THEN 'brute_force'
  WHEN contains(x, 'sql') OR contains(x, 'xss') OR contains(x, 'injection') OR contains(x, 'browserhijacking') OR contains(x, 'upload') THEN 'web_injection'
  WHEN contains(x, 'backdoor') OR contains(x, 'ransom') OR contains(x, 'malware') THEN 'malware' ELSE 'other' END"""


@query("p5_attack_family", f"SELECT p_partkey, {_FAMILY_SQL} AS family FROM (SELECT p_partkey, replace(replace(lower(trim({LABEL_TEXT})), '_', '-'), ' ', '') AS x FROM part)")
def p5(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", X.attack_family(F.expr(LABEL_TEXT)).alias("family"))


@query("p6_unsw_netflow_family", f"""SELECT p_partkey, CASE WHEN x IN ('normal', 'benign') THEN 'benign' WHEN x = '' THEN 'unknown' ELSE x END AS unsw,
  CASE WHEN x IN ('normal', 'benign') THEN 'benign' WHEN x IN ('ddos','dos','reconnaissance','theft','injection','password','xss','scanning','backdoor','mitm','ransomware') THEN x
    WHEN contains(x, 'scan') OR contains(x, 'recon') THEN 'reconnaissance' WHEN contains(x, 'ddos') THEN 'ddos' WHEN x LIKE 'dos%' THEN 'dos' WHEN x = '' THEN 'unknown' ELSE x END AS netflow
  FROM (SELECT p_partkey, replace(replace(lower(trim({LABEL_TEXT})), ' ', '_'), '-', '_') AS x FROM part)""")  # fmt: skip
def p6(spark, sf_dir):
    text = F.expr(LABEL_TEXT)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", X.unsw_family(text).alias("unsw"), X.netflow_family(text).alias("netflow"))


@query("p7_presence_hint", "SELECT l_orderkey, l_partkey, CAST((CASE WHEN l_discount > 1e-12 THEN 1 WHEN l_linestatus = 'F' THEN 1 WHEN l_tax = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS hint FROM lineitem")
def p7(spark, sf_dir):
    text = F.when(F.col("l_tax") == 0, "0.00").otherwise("0.0")  # a text of a zero says something unless it is `0` or `0.0`
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", F.col("l_discount").alias("TCP"), F.when(F.col("l_linestatus") == "F", "F").otherwise("None").alias("tcp.flags"), text.alias("tcp.len"))
    return df.select("l_orderkey", "l_partkey", evidence.present(df, ("TCP", "tcp.*")).cast("double").alias("hint"))


HINT_SQL = """h AS (SELECT s.*, CAST(protocol = 6 AS INT)::DOUBLE AS proto_tcp, CAST(protocol = 17 AS INT)::DOUBLE AS proto_udp, CAST(protocol = 1 AS INT)::DOUBLE AS proto_icmp,
  (CASE WHEN t1 <= 0 THEN in_bytes > 0 ELSE in_bytes >= t1 END)::INT::DOUBLE AS in_bytes_high, (CASE WHEN t2 <= 0 THEN out_bytes > 0 ELSE out_bytes >= t2 END)::INT::DOUBLE AS out_bytes_high,
  (CASE WHEN t3 <= 0 THEN in_pkts > 0 ELSE in_pkts >= t3 END)::INT::DOUBLE AS in_pkts_high, (CASE WHEN t4 <= 0 THEN out_pkts > 0 ELSE out_pkts >= t4 END)::INT::DOUBLE AS out_pkts_high,
  (CASE WHEN t5 <= 0 THEN duration > 0 ELSE duration >= t5 END)::INT::DOUBLE AS duration_high, (CASE WHEN t6 <= 0 THEN flags > 0 ELSE flags >= t6 END)::INT::DOUBLE AS tcp_flags_high,
  (src_port < 1024)::INT::DOUBLE AS src_port_low, (dst_port < 1024)::INT::DOUBLE AS dst_port_low
  FROM split s, (SELECT quantile_cont(in_bytes, 0.75) AS t1, quantile_cont(out_bytes, 0.75) AS t2, quantile_cont(in_pkts, 0.75) AS t3, quantile_cont(out_pkts, 0.75) AS t4, quantile_cont(duration, 0.75) AS t5, quantile_cont(flags, 0.75) AS t6 FROM split WHERE split = 'train'))"""
GATE_SQL = """g AS (SELECT *, 0.9 * proto_tcp AS g1, 0.75 * proto_udp AS g2, 0.7 * proto_icmp AS g3, 0.6 * least((in_bytes_high + out_bytes_high) / 2, 1) AS g4, 0.6 * least((in_pkts_high + out_pkts_high) / 2, 1) AS g5, 0.6 * duration_high AS g6, 0.7 * tcp_flags_high AS g7, 0.65 * least((src_port_low + dst_port_low) / 2, 1) AS g8 FROM h)"""
HINTS = [h.name for h in evidence.NETFLOW_HINTS]


def split_flows(spark, sf_dir):
    return sampling.stratified_split(flows(spark, sf_dir), "family", "key")


def hinted(spark, sf_dir):
    return evidence.add_hints(split_flows(spark, sf_dir), evidence.NETFLOW_HINTS, F.col("split") == "train")


def gated(spark, sf_dir, pool="sources"):
    return evidence.add_gates(hinted(spark, sf_dir), evidence.NETFLOW_HINTS, evidence.RELIABILITY["netflow"], pool)


@query("p8_p9_p10_j1_hints", f"WITH {SPLIT}, {HINT_SQL} SELECT key, {', '.join(HINTS)} FROM h")
def p8(spark, sf_dir):
    return hinted(spark, sf_dir).select("key", *[X.q(evidence.PREFIX + h).alias(h) for h in HINTS])


@query("p11_source_gate", f"WITH {SPLIT}, {HINT_SQL}, {GATE_SQL} SELECT key, in_bytes_high + out_bytes_high AS bytes_active, round(g4, 6) AS bytes_gate, round(in_bytes_high * g4, 6) AS in_bytes_gated, round((g1+g2+g3+g4+g5+g6+g7+g8) / 8, 6) AS gate_mean, round(greatest(g1,g2,g3,g4,g5,g6,g7,g8), 6) AS gate_max FROM g")
def p11(spark, sf_dir):
    p = evidence.PREFIX
    out = gated(spark, sf_dir).select("key", F.col(f"{p}bytes_active_count").alias("bytes_active"), F.col(f"{p}bytes_gate").alias("bytes_gate"), F.col(f"{p}in_bytes_high_source_gate").alias("in_bytes_gated"), F.col(f"{p}source_gate_mean").alias("gate_mean"), F.col(f"{p}source_gate_max").alias("gate_max"))
    return rounded(out, "bytes_gate", "in_bytes_gated", "gate_mean", "gate_max")


_GATED = {"proto_tcp": "g1", "proto_udp": "g2", "proto_icmp": "g3", "in_bytes_high": "g4", "out_bytes_high": "g4", "in_pkts_high": "g5", "out_pkts_high": "g5", "duration_high": "g6", "tcp_flags_high": "g7", "src_port_low": "g8", "dst_port_low": "g8"}


@query("p11_gate_pool_all", f"WITH {SPLIT}, {HINT_SQL}, {GATE_SQL} SELECT key, round((g1+g2+g3+g4+g5+g6+g7+g8 + {' + '.join(f'{h} * {g}' for h, g in _GATED.items())}) / 19, 6) AS gate_mean FROM g")
def p11_all(spark, sf_dir):
    return rounded(gated(spark, sf_dir, "all").select("key", F.col(f"{evidence.PREFIX}source_gate_mean").alias("gate_mean")), "gate_mean")


_COLUMNS = {h.name: h.name for h in evidence.NETFLOW_HINTS}
#: The hints shuffled within each split: the ones go to the first rows in the hash order of the column.
_ONES = ", ".join(f"sum({h}) OVER (PARTITION BY split) AS ones_{h}, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('|', '42', '{evidence.PREFIX}{h}', CAST(key AS VARCHAR))), key) AS place_{h}" for h in _COLUMNS)
_RANDOM = f"o AS (SELECT key, split, {_ONES} FROM h), r AS (SELECT key, " + ", ".join(f"(place_{h} <= ones_{h})::INT::DOUBLE AS {h}" for h in _COLUMNS) + " FROM o)"
_HINT_SUM = " + ".join(_COLUMNS)
_GATE_MEAN = "(g1+g2+g3+g4+g5+g6+g7+g8) / 8"


def _mode_sql(mode: str, n: int, table: str, hints: str, gates: str) -> str:
    return f"SELECT '{mode}' AS mode, CAST({n} AS BIGINT) AS n_columns, count(*) AS n, round({hints}, 3) AS hints, round({gates}, 3) AS gates, round({gates.replace('sum(', 'sum(power(').removesuffix(')') + ', 2))' if gates != '0.0' else gates}, 3) AS squares FROM {table}"


_MODES_SQL = " UNION ALL ".join((
    _mode_sql("traffic_only", 0, "h", "0.0", "0.0"), _mode_sql("weak_cti_concat", 11, "h", f"sum({_HINT_SUM})", "0.0"), _mode_sql("source_gate", 40, "g", f"sum({_HINT_SUM})", f"sum({_GATE_MEAN})"),
    _mode_sql("source_gate_pruned", 29, "g", "0.0", f"sum({_GATE_MEAN})"), _mode_sql("random_cti", 11, "r", f"sum({_HINT_SUM})", "0.0"), _mode_sql("random_source_gate", 40, "rg", f"sum({_HINT_SUM})", f"sum({_GATE_MEAN})"),
))


@query("p12_evidence_modes", f"WITH {SPLIT}, {HINT_SQL}, {GATE_SQL}, {_RANDOM}, {GATE_SQL.replace('g AS (', 'rg AS (', 1).replace('FROM h)', 'FROM r)')} {_MODES_SQL}")
def p12(spark, sf_dir):
    frames = evidence.evidence_modes(split_flows(spark, sf_dir), evidence.MODES, evidence.NETFLOW_HINTS, evidence.RELIABILITY["netflow"], "split", "key", F.col("split") == "train")
    gate, out = F.col(evidence.PREFIX + "source_gate_mean"), []
    held = sum((X.q(evidence.PREFIX + h) for h in HINTS), F.lit(0.0))
    # the modes without random hints show what the gated frame has, the others what the random one has: an aggregate each
    for full, modes in (("source_gate", evidence.MODES[:4]), ("random_source_gate", evidence.MODES[4:])):
        one = frames[full].agg(F.count(F.lit(1)).alias("n"), F.sum(held).alias("h"), F.sum(gate).alias("g"), F.sum(F.pow(gate, F.lit(2.0))).alias("s"))
        rows = []
        for m in modes:
            columns = frames[m].columns
            has = {"h": evidence.PREFIX + HINTS[0] in columns, "g": evidence.PREFIX + "source_gate_mean" in columns}
            pick = lambda c, k: F.col(c) if has[k] else F.lit(0.0)  # noqa: B023, E731
            rows.append(F.struct(F.lit(m).alias("mode"), F.lit(len([c for c in columns if c.startswith(evidence.PREFIX)])).cast("long").alias("n_columns"), "n", pick("h", "h").alias("hints"), pick("g", "g").alias("gates"), pick("s", "g").alias("squares")))
        out.append(one.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return rounded(report.union_all(out), "hints", "gates", "squares", places=3)


@query("p18_evidence_poisoning", f"WITH {SPLIT}, {HINT_SQL}, c AS (SELECT key, split, proto_tcp, substr(md5(concat_ws('|', '42', 'poison', CAST(key AS VARCHAR))), 1, 8) < '4ccccccd' AS chosen FROM h), a AS (SELECT key, split, row_number() OVER (PARTITION BY split ORDER BY key) AS p FROM c WHERE chosen), b AS (SELECT split, proto_tcp, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('|', '42', '_row', CAST(key AS VARCHAR))), key) AS p FROM c WHERE chosen) SELECT a.key, b.proto_tcp FROM a JOIN b ON a.split = b.split AND a.p = b.p UNION ALL SELECT key, proto_tcp FROM c WHERE NOT chosen")
def p18_poison(spark, sf_dir):
    c = evidence.PREFIX + "proto_tcp"
    return evidence.poison_evidence(hinted(spark, sf_dir), [c], 0.3, "split", "key").select("key", F.col(c).alias("proto_tcp"))


@query("p13_scale_evidence", f"WITH {SPLIT}, {HINT_SQL} SELECT key, round(in_bytes, 6) AS f0, round(proto_tcp * 0.5, 6) AS f1 FROM h")
def p13(spark, sf_dir):
    names = ["IN_BYTES", evidence.PREFIX + "proto_tcp"]
    df = hinted(spark, sf_dir).select("key", evidence.scale_evidence(F.array(*[X.q(n).cast("double") for n in names]), names, 0.5).alias("f"))
    return rounded(df.select("key", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1")), "f0", "f1")


@query("p14_flip_labels", "SELECT vec_id AS key, CAST(CASE WHEN vec_id % 10 < 2 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS y FROM embeddings")
def p14(spark, sf_dir):
    df = logits(spark, sf_dir).withColumn("client", F.col("key") % 10)
    return df.select("key", federated.flip_labels(F.col("y"), 10, federated.malicious(F.col("client"), 10, 0.2)).cast("int").alias("y"))


@query("p14_p17_scale_updates", f"WITH {UPDATES}, b AS (SELECT coord AS c, sum(value * n) / sum(n) AS v FROM updates GROUP BY 1) SELECT client, coord, round(CASE WHEN client < 2 THEN v + 5.0 * (value - v) ELSE value END, 6) AS value, n FROM updates JOIN b ON coord = c")
def p14b(spark, sf_dir):
    u = updates(spark, sf_dir)
    return rounded(federated.scale_updates(u, federated.weighted_average(u), federated.malicious(F.col("client"), 10, 0.2), 5.0), "value")


_FEATS = (("IN_BYTES", "in_bytes"), ("OUT_BYTES", "out_bytes"), ("IN_PKTS", "in_pkts"))


@query("p15_a4_standardise", f"WITH {SPLIT}, st AS (SELECT " + ", ".join(f"avg({b}) AS m_{b}, stddev_pop({b}) AS s_{b}" for _, b in _FEATS) + " FROM split WHERE split = 'train') SELECT key, " + ", ".join(f"round(({b} - m_{b}) / s_{b}, 5) AS {b}" for _, b in _FEATS) + ", (skewed = 'benign')::INT::DOUBLE AS is_benign FROM split, st")
def p15(spark, sf_dir):
    df = split_flows(spark, sf_dir).select("key", "split", "skewed", *[a for a, _ in _FEATS])
    spec = features.fit_spec(df.where("split = 'train'"), exclude=("key", "split"))
    out = features.transform(df, spec)
    names = features.feature_names(spec)
    return rounded(out.select("key", *[F.col("features")[names.index(a)].alias(b) for a, b in _FEATS], F.col("features")[names.index("skewed=benign")].alias("is_benign")), *[b for _, b in _FEATS], places=5)


@query("p16_panel_and_boundary", f"WITH {RUNS} SELECT dataset, seed, round(macro_f1, 6) AS macro_f1, CASE WHEN contains(lower(scenario || ' boundary'), 'stress') THEN 'stress' ELSE 'boundary' END AS boundary FROM runs WHERE scenario = 'source_gate'")
def p16(spark, sf_dir):
    df = report.require_rows(runs(spark, sf_dir), "source_gate", "scenario")
    return rounded(df.select("dataset", "seed", "macro_f1", report.boundary_tag(F.concat("scenario", F.lit(" boundary"))).alias("boundary")), "macro_f1")


@query("p18_evidence_dropout", f"WITH {SPLIT}, {HINT_SQL} SELECT key, CASE WHEN substr(md5(concat_ws('|', '42', 'dropout', CAST(key AS VARCHAR))), 1, 8) < '4ccccccd' THEN 0.0 ELSE proto_tcp END AS proto_tcp FROM h")
def p18(spark, sf_dir):
    c = evidence.PREFIX + "proto_tcp"
    return evidence.drop_evidence(hinted(spark, sf_dir), [c], 0.3, "key").select("key", F.col(c).alias("proto_tcp"))


# ---- joins and sets ------------------------------------------------------------------------------------------------


@query("j2_t2_encode_labels", f"WITH {SPLIT}, d AS (SELECT family AS label, CAST(row_number() OVER (ORDER BY family) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT family FROM split WHERE split = 'train')) SELECT key, label_id FROM split JOIN d ON family = label WHERE split = 'test'")
def j2(spark, sf_dir):
    df = split_flows(spark, sf_dir)
    dim = labels.label_dimension(df.where("split = 'train'"), "family")
    return labels.encode(df.where("split = 'test'"), dim, "family").select("key", F.col("label_id").cast("int").alias("label_id"))


@query("j3_baseline_deltas", f"WITH {RUNS} SELECT r.dataset, r.seed, r.scenario, round(r.macro_f1 - b.macro_f1, 6) AS delta_macro_f1_vs_traffic_only, round(r.ece - b.ece, 6) AS delta_ece_vs_traffic_only FROM runs r JOIN runs b ON r.dataset = b.dataset AND r.seed = b.seed AND b.scenario = 'traffic_only' WHERE r.scenario <> 'traffic_only'")
def j3(spark, sf_dir):
    out = report.baseline_deltas(runs(spark, sf_dir), ["dataset", "seed"], "traffic_only", ["macro_f1", "ece"])
    return rounded(out, "delta_macro_f1_vs_traffic_only", "delta_ece_vs_traffic_only")


@query("j4_pairwise_deltas", f"WITH {RUNS}, l AS (SELECT dataset, seed, scenario, 'macro_f1' AS metric, macro_f1 AS value FROM runs UNION ALL SELECT dataset, seed, scenario, 'ece', ece FROM runs) SELECT b.dataset, b.seed, b.scenario || '_minus_' || a.scenario AS comparison, b.metric, round(b.value - a.value, 6) AS delta FROM l a JOIN l b ON a.dataset = b.dataset AND a.seed = b.seed AND a.metric = b.metric AND a.scenario < b.scenario")
def j4(spark, sf_dir):
    return rounded(report.pairwise_deltas(runs(spark, sf_dir).select("dataset", "seed", "scenario", "macro_f1", "ece"), ["dataset", "seed"], ["macro_f1", "ece"]), "delta")


@query("j5_client_distances", f"WITH {UPDATES} SELECT a.client AS a, b.client AS b, round(sum((a.value - b.value) ** 2), 8) AS distance FROM updates a JOIN updates b ON a.coord = b.coord AND a.client <> b.client GROUP BY ALL")
def j5(spark, sf_dir):
    return rounded(federated.client_distances(updates(spark, sf_dir)), "distance", places=8)


@query("j6_permute_column", f"WITH {SPLIT}, a AS (SELECT key, split, row_number() OVER (PARTITION BY split ORDER BY key) AS p FROM split), b AS (SELECT split, in_bytes, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('|', '42', 'IN_BYTES', CAST(key AS VARCHAR))), key) AS p FROM split) SELECT a.key, b.in_bytes FROM a JOIN b ON a.split = b.split AND a.p = b.p")
def j6(spark, sf_dir):
    return evidence.permute_column(split_flows(spark, sf_dir), "IN_BYTES", "split", "key").select("key", F.col("IN_BYTES").alias("in_bytes"))


@query("h2_permute_binary", f"WITH {SPLIT}, {HINT_SQL}, o AS (SELECT *, sum(in_bytes_high) OVER (PARTITION BY split) AS ones, row_number() OVER (PARTITION BY split ORDER BY md5(concat_ws('|', '42', '_cti_in_bytes_high', CAST(key AS VARCHAR))), key) AS p FROM h) SELECT key, (p <= ones)::INT::DOUBLE AS in_bytes_high FROM o")
def h2(spark, sf_dir):
    c = evidence.PREFIX + "in_bytes_high"
    return evidence.permute_binary(hinted(spark, sf_dir), [c], "split", "key").select("key", F.col(c).alias("in_bytes_high"))


MAPPING = [("click", "recon", "T1595"), ("purchase", "dos", "T1498"), ("benign", "benign", "")]
_MAP_SQL = "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in MAPPING) + ") t(raw, mapped, technique))"


def mapping(spark):
    return spark.createDataFrame(MAPPING, "raw string, mapped string, technique string")


@query("j8_label_mapping", f"WITH {FLOWS}, {_MAP_SQL} SELECT key, mapped, technique FROM flows LEFT JOIN m ON family = raw")
def j8(spark, sf_dir):
    return labels.map_labels(flows(spark, sf_dir), mapping(spark), "family").select("key", "mapped", "technique")


@query("j8_unmapped_labels", f"WITH {FLOWS}, {_MAP_SQL} SELECT family AS raw, count(*) AS n FROM flows WHERE family NOT IN (SELECT raw FROM m) GROUP BY 1")
def j8b(spark, sf_dir):
    return labels.unmapped(flows(spark, sf_dir), mapping(spark), "family")


@query("j9_leave_family_out", f"WITH {FLOWS} SELECT key, CASE WHEN skewed = 'recon' THEN 'held_out' ELSE 'train' END AS part FROM flows")
def j9(spark, sf_dir):
    held = spark.createDataFrame([("recon",)], "family string")
    rest, out = labels.leave_families_out(flows(spark, sf_dir), held, "skewed")
    return rest.select("key", F.lit("train").alias("part")).unionByName(out.select("key", F.lit("held_out").alias("part")))


@query("u3_unseen_labels", f"WITH {FLOWS} SELECT DISTINCT skewed AS label FROM flows WHERE k >= 50 EXCEPT SELECT DISTINCT skewed FROM flows WHERE k < 96")
def u3(spark, sf_dir):
    df = flows(spark, sf_dir)
    return labels.unseen_labels(df.where("k < 96"), df.where("k >= 50"), "skewed")


# ---- aggregations --------------------------------------------------------------------------------------------------


@query("a1_family_counts", f"WITH {FLOWS} SELECT CAST(user_id % 3 AS VARCHAR) AS dataset, skewed AS family, count(*) AS n FROM flows GROUP BY ROLLUP (1, 2)")
def a1(spark, sf_dir):
    return report.family_counts(flows(spark, sf_dir).withColumn("d", (F.col("user_id") % 3).cast("string")), "skewed", "d")


@query("a2_label_fractions", f"WITH {FLOWS} SELECT skewed AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM flows GROUP BY 1")
def a2(spark, sf_dir):
    return rounded(profile.label_fractions(flows(spark, sf_dir), "skewed"), "fraction")


_PROFILED = ("l_quantity", "l_discount", "l_returnflag", "l_linestatus")


@query("a3_p4_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, round(avg((TRY_CAST({c} AS DOUBLE) IS NOT NULL)::INT), 6) AS parse_ratio, count(DISTINCT {c}) AS n_distinct, '{k}' AS kind, '' AS reason FROM lineitem" for c, k in zip(_PROFILED, ("numeric", "numeric", "categorical", "categorical"))))
def a3(spark, sf_dir):
    p = profile.profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_PROFILED), list(_PROFILED))
    return rounded(profile.with_kinds(p).select("column_name", "n", "parse_ratio", "n_distinct", "kind", "reason"), "parse_ratio")


@query("a4_impute_stats", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(median(x), 3) AS median, round(avg(x), 3) AS mean, round(stddev_pop(x), 3) AS std FROM (SELECT coalesce(v, (SELECT median(w) FROM (SELECT CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE {c} END AS w FROM lineitem))) AS x FROM (SELECT CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE {c} END AS v FROM lineitem))" for c in ("l_quantity", "l_extendedprice")))
def a4(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    df = df.select(*[F.when(F.col("l_partkey") % 7 != 0, F.col(c)).alias(c) for c in ("l_quantity", "l_extendedprice")])
    return rounded(profile.impute_stats(df, df.columns), "median", "mean", "std", places=3)


@query("a5_quantile_thresholds", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.75), 6) AS threshold FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def a5(spark, sf_dir):
    return rounded(profile.quantile_thresholds(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_extendedprice", "l_tax"]), "threshold")


@query("a6_category_lists", "SELECT 'l_returnflag' AS column_name, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS categories FROM lineitem UNION ALL SELECT 'l_linestatus', string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) FROM lineitem")
def a6(spark, sf_dir):
    out = profile.category_lists(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag", "l_linestatus"])
    return out.select("column_name", F.array_join("categories", ",").alias("categories"))


COUNTS_SQL = f"{LOGITS}, d AS (SELECT i AS label_id FROM range(0, 10) t(i)), c AS (SELECT CAST(label_id AS INTEGER) AS label_id, (SELECT count(*) FROM scored WHERE y = label_id AND pred = label_id) AS tp, (SELECT count(*) FROM scored WHERE y <> label_id AND pred = label_id) AS fp, (SELECT count(*) FROM scored WHERE y = label_id AND pred <> label_id) AS fn FROM d), f AS (SELECT *, tp / (tp + fp + 1e-12) AS p, tp / (tp + fn + 1e-12) AS r FROM c)"


def class_rows(spark, sf_dir):
    dim = spark.range(10).select(F.col("id").cast("int").alias("label_id"))
    return metrics.class_counts(metrics.confusion(scored(spark, sf_dir)), dim)


@query("f1_softmax", f"WITH {LOGITS} SELECT key, pred, round(confidence, 6) AS confidence, round(probs[1], 6) AS p0 FROM scored")
def f1(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("key", "pred", "confidence", F.col("probs")[0].alias("p0")), "confidence", "p0")


_W = [[((i * 7 + k * 3) % 11 - 5) / 10 for k in range(3)] for i in range(4)]


@query("f2_linear_score", "SELECT vec_id AS key, " + ", ".join("round(" + " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * ({_W[i][k]})" for i in range(4)) + f" + {k * 0.1}, 6) AS z{k}" for k in range(3)) + " FROM embeddings")
def f2(spark, sf_dir):
    import numpy as np

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("features"))
    out = metrics.score_linear(e, np.array(_W), np.array([k * 0.1 for k in range(3)]))
    return rounded(out.select("key", *[F.col("logits")[k].alias(f"z{k}") for k in range(3)]), "z0", "z1", "z2")


@query("f2_h3_batch_score", "SELECT vec_id AS key, round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * (i % 5))), 5) AS z0 FROM embeddings")
def f2_h3(spark, sf_dir):
    import numpy as np

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))
    w = np.array([[float((i + 1) % 5)] + [1.0] * 7 for i in range(64)])
    return rounded(metrics.score_linear(e, w, np.zeros(8)).select("key", F.col("logits")[0].alias("z0")), "z0", places=5)


@query("a7_class_counts", f"WITH {COUNTS_SQL} SELECT label_id, tp, fp, fn, tp + fn AS support FROM c")
def a7(spark, sf_dir):
    return class_rows(spark, sf_dir)


@query("a8_family_scores", f"WITH {COUNTS_SQL} SELECT label_id, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-12), 6) AS f1 FROM f")
def a8(spark, sf_dir):
    return rounded(metrics.family_scores(class_rows(spark, sf_dir)).select("label_id", "precision", "recall", "f1"), "precision", "recall", "f1")


@query("a8_summary", f"WITH {COUNTS_SQL} SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(2 * p * r / (p + r + 1e-12)), 6) AS macro_f1 FROM f")
def a8b(spark, sf_dir):
    return rounded(metrics.summary_scores(metrics.family_scores(class_rows(spark, sf_dir))), "accuracy", "macro_f1")


@query("a9_normal_fpr", f"WITH {LOGITS} SELECT round(avg((pred NOT IN (0, 1))::INT), 6) AS normal_fpr FROM scored WHERE y IN (0, 1)")
def a9(spark, sf_dir):
    return rounded(metrics.normal_fpr(scored(spark, sf_dir), [0, 1]), "normal_fpr")


BINS_SQL = "b AS (SELECT CAST(least(floor(confidence * 15), 14) AS INTEGER) AS bin, count(*) AS n, avg((pred = y)::INT) AS accuracy, avg(confidence) AS confidence FROM scored GROUP BY 1)"


@query("a10_a11_calibration", f"WITH {LOGITS}, {BINS_SQL} SELECT round((SELECT sum(n * abs(accuracy - confidence)) / sum(n) FROM b), 6) AS ece, round(avg(list_sum(list_transform(probs, lambda v, i: (v - (i - 1 = y)::INT) ** 2))), 6) AS brier, round(avg(confidence), 6) AS mean_confidence FROM scored")
def a10(spark, sf_dir):
    return rounded(metrics.calibration(scored(spark, sf_dir)), "ece", "brier", "mean_confidence")


@query("a12_reliability_table", f"WITH {LOGITS}, {BINS_SQL} SELECT bin, n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence, round(abs(accuracy - confidence), 6) AS gap FROM b")
def a12(spark, sf_dir):
    return rounded(metrics.reliability_table(scored(spark, sf_dir)), "accuracy", "confidence", "gap")


_GRID = "[" + ", ".join(f"{t:.2f}" for t in calibrate.GRID) + "]"
NLL_SQL = f"g AS (SELECT i AS g, CAST({_GRID}[i] AS DOUBLE) AS t FROM range(1, 47) r(i)), x AS (SELECT key, y, gate, g, t, list_transform(logits, lambda v: v / t) AS z FROM s0, g), l AS (SELECT key, y, gate, g, t, -ln(exp(z[y + 1] - list_max(z)) / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))) + 1e-12) AS loss FROM x)"


@query("a13_nll_grid", f"WITH {LOGITS}, {NLL_SQL} SELECT CAST(g - 1 AS INTEGER) AS grid, round(avg(loss), 6) AS nll FROM l GROUP BY g")
def a13(spark, sf_dir):
    return rounded(calibrate.temperature_losses(logits(spark, sf_dir)).select(F.posexplode("nll").alias("grid", "nll")), "nll")


@query("a14_fit_temperature", f"WITH {LOGITS}, {NLL_SQL}, m AS (SELECT g, t, avg(loss) AS nll FROM l GROUP BY g, t) SELECT round(t, 6) AS temperature, round(nll, 6) AS nll FROM m ORDER BY m.nll, g LIMIT 1")
def a14(spark, sf_dir):
    return rounded(calibrate.best_temperature(calibrate.temperature_losses(logits(spark, sf_dir))).select("temperature", F.array_min("nll").alias("nll")), "temperature", "nll")


_BIN = "(gate > (SELECT quantile_cont(gate, 1.0 / 3) FROM s0))::INT + (gate > (SELECT quantile_cont(gate, 2.0 / 3) FROM s0))::INT"


@query("a15_j7_gate_temperatures", f"WITH {LOGITS}, {NLL_SQL}, m AS (SELECT {_BIN} AS gate_bin, g, t, avg(loss) AS nll, count(*) AS n FROM l GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY gate_bin ORDER BY nll, g) AS r FROM m) SELECT CAST(gate_bin AS INTEGER) AS gate_bin, n, round(t, 6) AS temperature FROM o WHERE r = 1")
def a15(spark, sf_dir):
    temperatures, _ = calibrate.binned_temperatures(logits(spark, sf_dir), "gate", 3)
    return rounded(temperatures, "temperature")


@query("j7_apply_gate_temperatures", f"WITH {LOGITS}, {NLL_SQL}, m AS (SELECT {_BIN} AS gate_bin, g, t, avg(loss) AS nll FROM l GROUP BY ALL), o AS (SELECT gate_bin AS gb, t AS temperature, row_number() OVER (PARTITION BY gate_bin ORDER BY nll, g) AS r FROM m), q AS (SELECT key, logits, temperature, list_transform(logits, lambda v: v / temperature) AS z FROM s0 JOIN o ON {_BIN} = gb AND r = 1) SELECT key, round(temperature, 6) AS temperature, round(list_max(list_transform(z, lambda v: exp(v - list_max(z)))) / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))), 6) AS confidence FROM q")
def j7(spark, sf_dir):
    df = logits(spark, sf_dir)
    temperatures, thresholds = calibrate.binned_temperatures(df, "gate", 3)
    return rounded(calibrate.apply_binned(df, "gate", temperatures, thresholds).select("key", "temperature", F.array_max("probs").alias("confidence")), "temperature", "confidence")


@query("a16_class_weights", f"WITH {FLOWS}, c AS (SELECT skewed AS label, count(*) AS n FROM flows GROUP BY 1), w AS (SELECT *, sum(n) OVER () / n AS w FROM c) SELECT label, n, round(w / avg(w) OVER (), 6) AS weight FROM w")
def a16(spark, sf_dir):
    return rounded(train.class_weights(flows(spark, sf_dir), "skewed"), "weight")


@query("a17_weighted_average", f"WITH {UPDATES} SELECT coord, round(sum(value * n) / sum(n), 8) AS value FROM updates GROUP BY 1")
def a17(spark, sf_dir):
    return rounded(federated.aggregate(updates(spark, sf_dir), "avg"), "value", places=8)


@query("a18_coordinate_median", f"WITH {UPDATES} SELECT coord, round(median(value), 8) AS value FROM updates GROUP BY 1")
def a18(spark, sf_dir):
    return rounded(federated.aggregate(updates(spark, sf_dir), "median"), "value", places=8)


@query("a19_trimmed_mean", f"WITH {UPDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY coord ORDER BY value, client) AS r FROM updates) SELECT coord, round(avg(value), 8) AS value FROM r WHERE r > 2 AND r <= 8 GROUP BY 1")
def a19(spark, sf_dir):
    return rounded(federated.aggregate(updates(spark, sf_dir), "trimmed_mean", trim=0.2), "value", places=8)


KRUM = f"{UPDATES}, d AS (SELECT a.client AS a, b.client AS b, sum((a.value - b.value) ** 2) AS distance FROM updates a JOIN updates b ON a.coord = b.coord AND a.client <> b.client GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS r FROM d), s AS (SELECT a AS client, sum(distance) AS score FROM k WHERE r <= 6 GROUP BY 1)"


@query("a20_t5_krum_scores", f"WITH {KRUM} SELECT client, round(score, 8) AS score FROM s")
def a20(spark, sf_dir):
    return rounded(federated.krum_scores(updates(spark, sf_dir), 2), "score", places=8)


@query("a20_krum", f"WITH {KRUM} SELECT coord, round(value, 8) AS value FROM updates WHERE client = (SELECT client FROM s ORDER BY score, client LIMIT 1)")
def a20b(spark, sf_dir):
    return rounded(federated.aggregate(updates(spark, sf_dir), "krum", faulty=2), "value", places=8)


@query("a21_communication_cost", "SELECT l_returnflag AS grp, count(DISTINCT l_suppkey) AS clients, round((56 * 15 + 15) * 4 / 1048576.0 * count(DISTINCT l_suppkey) * 2, 8) AS mb FROM lineitem GROUP BY 1")
def a21(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("grp")).agg(F.count_distinct("l_suppkey").alias("clients"))
    return rounded(df.withColumn("mb", F.col("clients") * federated.communication_mb(56, 15, 1)), "mb", places=8)


@query("a22_seed_summary", f"WITH {RUNS} SELECT dataset, scenario, count(*) AS n, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_samp(macro_f1), 6) AS macro_f1_std, round(avg(ece), 6) AS ece_mean, round(stddev_samp(ece), 6) AS ece_std FROM runs GROUP BY ALL")
def a22(spark, sf_dir):
    return rounded(report.seed_summary(runs(spark, sf_dir), ["dataset", "scenario"], ["macro_f1", "ece"]), "macro_f1_mean", "macro_f1_std", "ece_mean", "ece_std")


@query("a23_per_family_summary", f"WITH {FLOWS}, r AS (SELECT skewed AS family, CAST(user_id % 3 AS BIGINT) AS seed, avg((k % 2 = 0)::INT) AS recall FROM flows GROUP BY ALL) SELECT family, count(*) AS n, round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std FROM r GROUP BY 1")
def a23(spark, sf_dir):
    r = flows(spark, sf_dir).groupBy(F.col("skewed").alias("family"), (F.col("user_id") % 3).alias("seed")).agg(F.avg((F.col("k") % 2 == 0).cast("double")).alias("recall"))
    return rounded(report.seed_summary(r, ["family"], ["recall"]), "recall_mean", "recall_std")


@query("a24_family_rollup", f"WITH {COUNTS_SQL} SELECT CASE WHEN label_id < 2 THEN 'benign' WHEN label_id < 6 THEN 'dos' ELSE 'recon' END AS family, round(sum(tp) / (sum(tp + fn) + 1e-12), 6) AS recall, CAST(sum(tp + fn) AS BIGINT) AS support FROM c GROUP BY 1")
def a24(spark, sf_dir):
    fam = spark.range(10).select(F.col("id").cast("int").alias("label"), F.when(F.col("id") < 2, "benign").when(F.col("id") < 6, "dos").otherwise("recon").alias("family"))
    return rounded(report.family_rollup(class_rows(spark, sf_dir).withColumnRenamed("label_id", "label"), fam), "recall")


@query("a26_schema_probe", "SELECT 'lineitem' AS dataset, count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, 'l_returnflag,l_linestatus' AS label_candidates, 'l_quantity,l_extendedprice' AS flow_columns FROM lineitem UNION ALL SELECT 'events', count(*), 6, 'event_type', 'value' FROM events")
def a26(spark, sf_dir):
    return report.schema_probe({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "events")})


@query("a27_ranking_scores", f"WITH {LOGITS}, c AS (SELECT probs[1] AS s, sum((y = 0)::INT) AS p, sum((y <> 0)::INT) AS m FROM scored GROUP BY 1), r AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(m) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS tot_p, sum(m) OVER () AS tot_m FROM c) SELECT round(sum(m * (tp - p / 2.0)) / (max(tot_p) * max(tot_m)), 6) AS auroc, round(sum(p / tot_p * (tp / (tp + fp))), 6) AS auprc FROM r")
def a27(spark, sf_dir):
    df = scored(spark, sf_dir).select(F.col("probs")[0].alias("s"), (F.col("y") == 0).alias("positive"))
    return rounded(metrics.ranking_scores(df, "s", "positive"), "auroc", "auprc")


_MACRO = " UNION ALL ".join(f"SELECT {k} AS k, probs[{k + 1}] AS s, sum((y = {k})::INT) AS p, sum((y <> {k})::INT) AS m FROM scored GROUP BY 2" for k in range(10))


@query("a27_macro_ranking", f"WITH {LOGITS}, c AS ({_MACRO}), r AS (SELECT *, sum(p) OVER w AS tp, sum(m) OVER w AS fp, sum(p) OVER (PARTITION BY k) AS tot_p, sum(m) OVER (PARTITION BY k) AS tot_m FROM c WINDOW w AS (PARTITION BY k ORDER BY s DESC)), e AS (SELECT k, sum(m * (tp - p / 2.0)) / nullif(max(tot_p) * max(tot_m), 0) AS auroc, sum(p / nullif(tot_p, 0) * (tp / (tp + fp))) AS auprc FROM r GROUP BY k) SELECT round(avg(auroc), 6) AS auroc, round(avg(auprc), 6) AS auprc, count(*) AS n_classes FROM e WHERE auroc IS NOT NULL")
def a27_macro(spark, sf_dir):
    return rounded(metrics.macro_ranking(scored(spark, sf_dir), 10), "auroc", "auprc")


@query("a27_retention", f"WITH {RUNS} SELECT c.dataset, c.seed, round(c.macro_f1, 6) AS clean, round(p.macro_f1, 6) AS poisoned, round(p.macro_f1 / nullif(c.macro_f1, 0), 6) AS retention FROM runs c JOIN runs p ON c.dataset = p.dataset AND c.seed = p.seed WHERE c.scenario = 'source_gate' AND p.scenario = 'random_cti'")
def a27_retention(spark, sf_dir):
    r = runs(spark, sf_dir)
    return rounded(metrics.retention(r.where("scenario = 'source_gate'"), r.where("scenario = 'random_cti'"), "macro_f1", ("dataset", "seed")), "clean", "poisoned", "retention")


# ---- windows, samples, splits --------------------------------------------------------------------------------------


@query("w1_h1_family_cap", f"WITH {FLOWS} SELECT key, skewed AS family FROM ({ranked_sql('cap', 'skewed')}) WHERE r <= 300")
def w1(spark, sf_dir):
    return sampling.family_cap(flows(spark, sf_dir), "skewed", "key", 300).select("key", F.col("skewed").alias("family"))


@query("w2_first_come_cap", f"WITH {FLOWS}, f AS (SELECT * FROM flows ORDER BY key LIMIT 5000) SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY skewed ORDER BY key) AS r FROM f) WHERE r <= 200")
def w2(spark, sf_dir):
    return sampling.first_come_cap(flows(spark, sf_dir), "skewed", "key", 200, 5000).select("key")


@query("w2_first_half", f"WITH {FLOWS}, f AS (SELECT *, 'k' || CAST(key AS VARCHAR) AS name FROM flows ORDER BY name LIMIT (SELECT count(*) // 2 FROM events)) SELECT name FROM (SELECT name, row_number() OVER (PARTITION BY skewed ORDER BY name) AS r FROM f) WHERE r <= 3000")
def w2_half(spark, sf_dir):
    """Half of the table, in the order of a text key."""
    df = flows(spark, sf_dir).select("skewed", F.concat(F.lit("k"), F.col("key").cast("string")).alias("name"))
    return sampling.first_come_cap(df, "skewed", "name", 3000, df.count() // 2).select("name")


@query("w3_stratified_split", f"WITH {SPLIT} SELECT key, split FROM split")
def w3(spark, sf_dir):
    return split_flows(spark, sf_dir).select("key", "split")


_VALID = f"v AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY md5(concat_ws('|', '42', 'valid', CAST(key AS VARCHAR))), key) AS r2, count(*) OVER (PARTITION BY family) AS n2 FROM split WHERE split = 'train')"


@query("w4_three_way_split", f"WITH {SPLIT}, {_VALID} SELECT key, split FROM split WHERE split = 'test' UNION ALL SELECT key, CASE WHEN r2 <= (CASE WHEN n2 <= 2 THEN 0 ELSE greatest(1, CAST(round_even(n2 * 0.2, 0) AS BIGINT)) END) THEN 'valid' ELSE 'train' END FROM v")
def w4(spark, sf_dir):
    return sampling.three_way_split(flows(spark, sf_dir), "family", "key", 0.25, 0.2).select("key", "split")


@query("w5_stratified_cap", f"WITH {FLOWS}, r AS ({ranked_sql('strata', 'skewed')}), t AS (SELECT count(*) AS total FROM flows), p AS (SELECT key FROM r, t WHERE r <= greatest(1, CAST(round_even(n * 777 / CAST(total AS DOUBLE), 0) AS BIGINT))) SELECT key FROM p ORDER BY md5(concat_ws('|', '42', 'trim', CAST(key AS VARCHAR))), key LIMIT 777")
def w5(spark, sf_dir):
    return sampling.stratified_cap(flows(spark, sf_dir), "skewed", "key", 777).select("key")


@query("w6_proportional_sample", f"WITH {FLOWS}, r AS ({ranked_sql('sample', 'skewed')}), t AS (SELECT count(*) AS total FROM flows) SELECT key FROM r, t WHERE r <= least(n, greatest(1, CAST(round_even(500 * (n / CAST(total AS DOUBLE)), 0) AS BIGINT)))")
def w6(spark, sf_dir):
    return sampling.proportional_sample(flows(spark, sf_dir), "skewed", "key", 500).select("key")


@query("w7_iid_clients", "SELECT event_id AS key, CAST(ntile(10) OVER (ORDER BY md5(concat_ws('|', '42', 'client', CAST(event_id AS VARCHAR))), event_id) - 1 AS INTEGER) AS client_id FROM events")
def w7(spark, sf_dir):
    return sampling.iid_clients(flows(spark, sf_dir), "key", 10).select("key", "client_id")


@query("w8_label_skew_clients", f"WITH {FLOWS}, s AS (SELECT key, ntile(20) OVER (ORDER BY family, key) - 1 AS shard FROM flows), d AS (SELECT i AS shard, (row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'shard', CAST(i AS VARCHAR))), i) - 1) % 10 AS client_id FROM range(0, 20) t(i)) SELECT key, CAST(client_id AS INTEGER) AS client_id FROM s JOIN d USING (shard)")
def w8(spark, sf_dir):
    return sampling.label_skew_clients(flows(spark, sf_dir), "family", "key", 10, 5).select("key", "client_id")


@query("w8_text_keys", f"WITH {FLOWS}, s AS (SELECT 'k' || CAST(key AS VARCHAR) AS name, ntile(20) OVER (ORDER BY family, 'k' || CAST(key AS VARCHAR)) - 1 AS shard FROM flows), d AS (SELECT i AS shard, (row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'shard', CAST(i AS VARCHAR))), i) - 1) % 10 AS client_id FROM range(0, 20) t(i)) SELECT name, CAST(client_id AS INTEGER) AS client_id FROM s JOIN d USING (shard)")
def w8_text(spark, sf_dir):
    df = flows(spark, sf_dir).select("family", F.concat(F.lit("k"), F.col("key").cast("string")).alias("name"))
    return sampling.label_skew_clients(df, "family", "name", 10, 5).select("name", "client_id")


@query("w9_shuffled_order", "SELECT event_id AS key, row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'shuffle', CAST(event_id AS VARCHAR))), event_id) AS place FROM events")
def w9_h5(spark, sf_dir):
    df = flows(spark, sf_dir).select("key", X.hash_order(42, "shuffle", F.col("key")).alias("h"))
    return sampling.distributed_row_number(df, [F.col("h"), F.col("key")], [sampling.hash_bucket(F.col("h"))], "place").select("key", "place")


CANDIDATES = f"{RUNS}, c AS (SELECT dataset, seed, scenario, macro_f1, ece, brier, ece + brier AS nll, length(scenario) / 10.0 AS alpha FROM runs)"


def candidates(spark, sf_dir):
    return runs(spark, sf_dir).select("dataset", "seed", "scenario", "macro_f1", "ece", "brier", (F.col("ece") + F.col("brier")).alias("nll"), (F.length("scenario") / 10.0).alias("alpha"))


@query("w10_select_band", f"WITH {CANDIDATES}, b AS (SELECT *, max(macro_f1) OVER (PARTITION BY dataset, seed) AS best FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY ece, nll, macro_f1 DESC, alpha) AS r FROM b WHERE macro_f1 >= best - greatest(0.010, 0.025 * abs(best))) SELECT dataset, seed, scenario FROM r WHERE r = 1")
def w10(spark, sf_dir):
    return calibrate.select_candidate(candidates(spark, sf_dir), ("dataset", "seed")).select("dataset", "seed", "scenario")


@query("w10_select_score", f"WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY macro_f1 - 0.75 * ece - 0.10 * brier DESC, ece, macro_f1 DESC, alpha) AS r FROM c) SELECT dataset, seed, scenario FROM r WHERE r = 1")
def w10b(spark, sf_dir):
    return calibrate.select_candidate(candidates(spark, sf_dir), ("dataset", "seed"), "score").select("dataset", "seed", "scenario")


@query("w11_last_rounds", f"WITH {RUNS} SELECT dataset, scenario, seed AS round, round(macro_f1, 6) AS macro_f1 FROM runs QUALIFY row_number() OVER (PARTITION BY dataset, scenario ORDER BY seed DESC) = 1")
def w11(spark, sf_dir):
    return rounded(report.last_rounds(runs(spark, sf_dir).select("dataset", "scenario", F.col("seed").alias("round"), "macro_f1"), ["dataset", "scenario"]), "macro_f1")


@query("t1_random_rows", "SELECT event_id AS key FROM events ORDER BY md5(concat_ws('|', '42', 'rows', CAST(event_id AS VARCHAR))), event_id LIMIT 250")
def t1(spark, sf_dir):
    return sampling.random_rows(flows(spark, sf_dir), "key", 250).select("key")


@query("t3_top_values", "WITH l AS (SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders), c AS (SELECT column_name, value, count(*) AS count FROM l GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 20")
def t3(spark, sf_dir):
    return report.top_values(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderpriority", "o_orderstatus"])


@query("t4_best_scenarios", f"WITH {RUNS} SELECT dataset, seed, scenario, round(macro_f1, 6) AS macro_f1 FROM runs QUALIFY row_number() OVER (PARTITION BY dataset, seed ORDER BY macro_f1 DESC, scenario) = 1")
def t4(spark, sf_dir):
    return rounded(report.best_scenarios(runs(spark, sf_dir), ["dataset", "seed"], "macro_f1"), "macro_f1")


# ---- unions, matrices, gates ---------------------------------------------------------------------------------------


@query("u1_union_frames", f"WITH {RUNS} SELECT dataset, round(macro_f1, 6) AS macro_f1, CAST(NULL AS DOUBLE) AS ece FROM runs WHERE seed = 42 UNION ALL SELECT dataset, NULL, round(ece, 6) FROM runs WHERE seed = 43")
def u1(spark, sf_dir):
    r = runs(spark, sf_dir)
    return rounded(report.union_all([r.where("seed = 42").select("dataset", "macro_f1"), r.where("seed = 43").select("dataset", "ece")]), "macro_f1", "ece")


MATRIX = f"{RUNS}, x AS (SELECT dataset, " + ", ".join(f"avg(macro_f1) FILTER (scenario = '{s}') AS {s}" for s in SCENARIOS) + " FROM runs GROUP BY 1)"
_LEADS = [s for s in SCENARIOS if s != "source_gate"]


def matrix(spark, sf_dir):
    return report.evidence_matrix(runs(spark, sf_dir), ["dataset"], "macro_f1", SCENARIOS)


@query("u2_evidence_matrix", f"WITH {MATRIX} SELECT dataset, " + ", ".join(f"round({s}, 6) AS {s}" for s in SCENARIOS) + ", " + ", ".join(f"round(source_gate - {s}, 6) AS source_delta_vs_{s}" for s in _LEADS) + " FROM x")
def u2(spark, sf_dir):
    return rounded(matrix(spark, sf_dir), *SCENARIOS, *[f"source_delta_vs_{s}" for s in _LEADS])


_BLOCKS = [
    report.Block("A", "all nations", "every nation, three seeds", "macro_f1", "Supported on every nation."),
    report.Block("B", "stress", "seed 43 alone", "macro_f1", "Stress probe, not a final result.", "seed = 43"),
    report.Block("C", "calibrated", "without weak hints", "macro_f1", "Negative or mixed calibration result.", scenarios=("traffic_only", "source_gate", "random_cti")),
    report.Block("D", "post-hoc calibration", "every nation, three seeds", "ece", "A boundary case.", scenarios=("traffic_only", "source_gate", "random_cti")),
]
_REACH = {"A": "supported", "B": "stress", "C": "boundary", "D": "boundary"}


def _block_sql(b: report.Block) -> str:
    value = {s: f"avg({b.metric}) FILTER (scenario = '{s}')" if s in b.scenarios else "CAST(NULL AS DOUBLE)" for s in SCENARIOS}
    cells = ", ".join(f"round({v}, 6) AS {s}" for s, v in value.items()) + f", round({value['source_gate']} - {value['traffic_only']}, 6) AS source_delta_vs_traffic, round({value['source_gate']} - {value['weak_cti']}, 6) AS source_delta_vs_weak"
    return f"SELECT '{b.panel}' AS panel, '{b.name}' AS evidence_block, '{b.scope}' AS scope, '{b.metric}' AS metric, {cells}, '{b.boundary}' AS boundary, '{_REACH[b.panel]}' AS reach FROM runs" + f" WHERE {b.rows}"


@query("u4_figure_source", f"WITH {RUNS} " + " UNION ALL ".join(map(_block_sql, _BLOCKS)))
def u4(spark, sf_dir):
    return rounded(report.figure_source(runs(spark, sf_dir), _BLOCKS), *SCENARIOS, "source_delta_vs_traffic", "source_delta_vs_weak")


@query("m7_claim_gates", f"WITH {MATRIX} " + " UNION ALL ".join(f"SELECT 'source_gate_beats_{s}' AS claim, bool_and(source_gate > {s}) AS holds, count(*) AS n FROM x" for s in _LEADS))
def m7(spark, sf_dir):
    return report.claim_gates(matrix(spark, sf_dir), _LEADS)


# ---- the flagship and learning jobs --------------------------------------------------------------------------------


@query("flagship_gate_profile", f"WITH {FLOWS}, split AS (SELECT *, CASE WHEN r <= {QUOTA} THEN 'test' ELSE 'train' END AS split FROM ({ranked_sql('split', 'skewed')})), {HINT_SQL}, {GATE_SQL} SELECT split, skewed AS family, count(*) AS n, round(avg((g1+g2+g3+g4+g5+g6+g7+g8) / 8), 6) AS gate_mean, round(max(greatest(g1,g2,g3,g4,g5,g6,g7,g8)), 6) AS gate_max FROM g GROUP BY ALL")
def flagship(spark, sf_dir):
    """All flows split by family, hinted and gated, and profiled by split and family."""
    split = sampling.stratified_split(flows(spark, sf_dir), "skewed", "key")
    out = evidence.add_gates(evidence.add_hints(split, evidence.NETFLOW_HINTS, F.col("split") == "train"), evidence.NETFLOW_HINTS, evidence.RELIABILITY["netflow"])
    p = evidence.PREFIX
    return rounded(out.groupBy("split", F.col("skewed").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.avg(f"{p}source_gate_mean").alias("gate_mean"), F.max(f"{p}source_gate_max").alias("gate_max")), "gate_mean", "gate_max")


def _target() -> Column:
    return F.when(F.col("skewed") == "benign", 0).when(F.col("skewed") == "dos", 1).otherwise(2).alias("y")


def training_rows(spark, sf_dir):
    """features (hints and gates), y, key, client_id, split, gate of the flows."""
    df = gated(spark, sf_dir)
    names = [c for c in df.columns if c.startswith(evidence.PREFIX)]
    return df.select("key", "split", _target(), (F.col("user_id") % 10).cast("int").alias("client_id"), F.array(*[X.q(c) for c in names]).alias("features"), X.q(evidence.PREFIX + "source_gate_mean").alias("gate"), "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS"), len(names)


def _feature_sql() -> list[str]:
    """The features of `training_rows` in their order, over the columns of the gates' SQL."""
    sources = list(evidence.RELIABILITY["netflow"])
    gates = dict(zip(sources, (f"g{k + 1}" for k in range(len(sources))), strict=True))
    out = list(HINTS)
    for s in sources:
        own = [h.name for h in evidence.NETFLOW_HINTS if h.source == s]
        out += [" + ".join(own), gates[s], *[f"{h} * {gates[s]}" for h in own]]
    every = list(gates.values())
    return [*out, f"({' + '.join(every)}) / {len(every)}", f"greatest({', '.join(every)})"]


_DEEP = len(_feature_sql()) + 1
#: The rows in long form: x of feature i, the last one the bias.
LONG = f"""{SPLIT}, {HINT_SQL}, {GATE_SQL}, x AS (SELECT key, split, CASE skewed WHEN 'benign' THEN 0 WHEN 'dos' THEN 1 ELSE 2 END AS y, CAST(user_id % 10 AS INTEGER) AS client, [{', '.join(f'CAST({f} AS DOUBLE)' for f in _feature_sql())}, 1.0] AS f FROM g),
c AS (SELECT k FROM range(0, 3) t(k))"""


def _steps_sql(name: str, before: str, of: str, per: str, new: str) -> str:
    """CTEs {name}p (probabilities by row and class at weights `before`) and {name} (weights after a step on rows `of`)."""
    on = f"i{', ' + per if per else ''}"
    return f"""{name}z AS (SELECT l.key, l.client, l.y, k, sum(v * w) AS z FROM l JOIN {before} USING ({on}) WHERE {of} GROUP BY ALL),
{name}p AS (SELECT key, client, y, k, exp(z) / sum(exp(z)) OVER (PARTITION BY key) AS p FROM {name}z),
{name}g AS (SELECT l.client, i, k, sum(v * (p - (k = q.y)::INT)) / count(*) AS g, count(*) AS n FROM l JOIN {name}p q ON l.key = q.key GROUP BY ALL),
{new}"""


_HALF = "(SELECT CAST(ceil(max(n) / 2.0) AS BIGINT) FROM (SELECT count(*) AS n FROM x WHERE split = 'train' GROUP BY client))"


@query("m3_client_updates", f"""WITH {LONG}, b AS (SELECT *, (row_number() OVER (PARTITION BY client ORDER BY md5(concat_ws('|', '42', 'batch0', CAST(key AS VARCHAR))), key) - 1) // {_HALF} AS batch, count(*) OVER (PARTITION BY client) AS rows_n FROM x WHERE split = 'train'),
l AS (SELECT key, client, batch, y, i, f[i] AS v FROM b, range(1, {_DEEP + 1}) t(i)), w0 AS (SELECT DISTINCT client, i, k, 0.0 AS w FROM l, c),
{_steps_sql("a", "w0", "batch = 0", "client", "w1 AS (SELECT client, i, k, w - 0.05 * coalesce(g, 0) AS w FROM w0 LEFT JOIN ag USING (client, i, k))")},
{_steps_sql("d", "w1", "batch = 1", "client", "w2 AS (SELECT client, i, k, w - CASE WHEN g IS NULL THEN 0 ELSE 0.05 * (g + 0.01 * w) END AS w FROM w1 LEFT JOIN dg USING (client, i, k))")}
SELECT client, CAST((i - 1) * 3 + k AS INTEGER) AS coord, round(w, 8) + 0.0 AS value, n FROM w2 JOIN (SELECT client, count(*) AS n FROM b GROUP BY 1) USING (client)""")  # fmt: skip
def m3(spark, sf_dir):
    """Two mini-batches of every client's rows, from zero weights."""
    import numpy as np

    df, width = training_rows(spark, sf_dir)
    rows = df.where("split = 'train'").persist()
    most = rows.groupBy("client_id").count().agg(F.max("count")).head()[0]
    out = federated.train_clients(rows, np.zeros((width + 1, 3)), 3, mu=0.01, batch_rows=-(-most // 2))
    rows.unpersist()
    return rounded(out, "value", places=8)


_JUDGED = "round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(normal_fpr, 6) AS normal_fpr, round(ece, 6) AS ece, round(brier, 6) AS brier, round(mean_confidence, 6) AS mean_confidence"


def _round_sql(name: str, before: str, merge: str, flip: bool) -> str:
    """A round of full-batch client steps merged into `name`, and its figures of the test rows, {name}m."""
    said = "CASE WHEN client < 2 THEN (y + 1) % 3 ELSE y END" if flip else "y"
    return f"""{name}z AS (SELECT key, any_value(client) AS client, any_value({said}) AS y, k, sum(v * w) AS z FROM l JOIN {before} USING (i) WHERE split = 'train' GROUP BY key, k),
{name}p AS (SELECT key, client, y, k, exp(z) / sum(exp(z)) OVER (PARTITION BY key) AS p FROM {name}z),
{name}u AS (SELECT q.client, i, k, sum(v * (p - (k = q.y)::INT)) / count(*) AS g, count(*) AS n FROM l JOIN {name}p q ON l.key = q.key GROUP BY ALL),
{name} AS (SELECT i, k, {merge} AS w FROM (SELECT i, k, w - 0.5 * g AS u, n FROM {name}u JOIN {before} USING (i, k)) GROUP BY i, k),
{name}t AS (SELECT *, max(p) OVER (PARTITION BY key) AS top FROM (SELECT key, y, k, exp(z) / sum(exp(z)) OVER (PARTITION BY key) AS p FROM (SELECT key, any_value(y) AS y, k, sum(v * w) AS z FROM l JOIN {name} USING (i) WHERE split = 'test' GROUP BY key, k))),
{name}s AS (SELECT key, any_value(y) AS y, min(k) FILTER (p = top) AS pred, any_value(top) AS top, sum((p - (k = y)::INT) ** 2) AS b FROM {name}t GROUP BY key),
{name}f AS (SELECT avg(2 * p * r / (p + r + 1e-12)) AS macro_f1 FROM (SELECT k, tp / (np + 1e-12) AS p, tp / (ny + 1e-12) AS r FROM (SELECT k, count(*) FILTER (y = k AND pred = k) AS tp, count(*) FILTER (pred = k) AS np, count(*) FILTER (y = k) AS ny FROM {name}s, c GROUP BY k))),
{name}e AS (SELECT sum(abs(h - cf)) / sum(n) AS ece FROM (SELECT least(floor(top * 15), 14) AS bin, sum((pred = y)::INT) AS h, sum(top) AS cf, count(*) AS n FROM {name}s GROUP BY 1)),
{name}m AS (SELECT avg((pred = y)::INT) AS accuracy, any_value(macro_f1) AS macro_f1, avg((pred <> 0)::INT) FILTER (y = 0) AS normal_fpr, any_value(ece) AS ece, avg(b) AS brier, avg(top) AS mean_confidence FROM {name}s, {name}f, {name}e)"""


_TWO_RUNS = (("clean_fedavg", "r", "sum(u * n) / sum(n)", False), ("label_flip_median", "q", "median(u)", True))


@query("m4_federated_rounds", f"WITH {LONG}, l AS (SELECT key, client, split, y, i, f[i] AS v FROM x, range(1, {_DEEP + 1}) t(i)), w0 AS (SELECT i, k, 0.0 AS w FROM range(1, {_DEEP + 1}) t(i), c), "
    + ", ".join(_round_sql(f"{n}{t}", f"{n}{t - 1}" if t > 1 else "w0", merge, flip) for _, n, merge, flip in _TWO_RUNS for t in (1, 2))
    + " " + " UNION ALL ".join(f"SELECT '{scenario}' AS scenario, CAST({t} AS INTEGER) AS round, {_JUDGED} FROM {n}{t}m" for scenario, n, *_ in _TWO_RUNS for t in (1, 2)))
def m4(spark, sf_dir):
    """Two rounds from zero weights: averaged clean clients, and the median with a fifth of them flipping labels."""
    df, width = training_rows(spark, sf_dir)
    runs_ = (federated.Run("clean_fedavg", rounds=2), federated.Run("label_flip_median", "median", "label_flip", 0.0, 0.2, 2))
    out = federated.scenario_matrix(df.where("split = 'train'"), df.where("split = 'test'"), 3, width, 10, runs=runs_, seeds=(42,), lr=0.5, spread=0.0)
    return rounded(out.select("scenario", "round", "accuracy", "macro_f1", "normal_fpr", "ece", "brier", "mean_confidence"), "accuracy", "macro_f1", "normal_fpr", "ece", "brier", "mean_confidence")


@query("m4_m5_scenario_matrix")
def m5(spark, sf_dir):
    """All scenarios over three seeds at their full number of rounds (50 and 30), two mini-batches a client and round,
    judged on the held-out rows after each round."""
    df, width = training_rows(spark, sf_dir)
    most = df.where("split = 'train'").groupBy("client_id").count().agg(F.max("count")).head()[0]
    return federated.scenario_matrix(df.where("split = 'train'"), df.where("split = 'test'"), 3, width, 10, batch_rows=-(-most // 2))


@query("m1_multinomial")
def m1(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    df, _ = training_rows(spark, sf_dir)
    df = df.persist()
    model = train.fit_multinomial(df.where("split = 'train'"))
    out = model.transform(df.where("split = 'test'").select("key", "y", array_to_vector("features").alias("features")))
    df.unpersist()
    return metrics.summary_scores(metrics.family_scores(metrics.class_counts(metrics.confusion(out.select("y", F.col("prediction").cast("int").alias("pred"))), spark.range(3).select(F.col("id").cast("int").alias("label_id")))))


@query("m2_h4_softmax")
def m2(spark, sf_dir):
    """Label smoothing and confidence penalty, to the optimum by L-BFGS."""
    import numpy as np

    df, width = training_rows(spark, sf_dir)
    df = train.over_cores(df).persist()
    w, losses = train.fit_softmax(df.where("split = 'train'"), 3, width, smoothing=0.05, penalty=0.01)
    df.unpersist()
    scores = metrics.score_logits(metrics.score_linear(df.where("split = 'test'"), np.asarray(w[:-1]), np.asarray(w[-1])))
    return metrics.calibration(scores).withColumn("first_loss", F.lit(losses[0])).withColumn("last_loss", F.lit(losses[-1])).withColumn("iterations", F.lit(len(losses) - 1))


@query("m6_alpha_grid")
def m6(spark, sf_dir):
    """Scale of the evidence chosen on validation rows by both rules over three seeds, among six scales, with the test
    figures raw, at one temperature and at those of two and three gate bins."""
    import numpy as np

    traffic, seeds = ["IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS"], (42, 43, 44)
    df = hinted(spark, sf_dir)
    hints = [c for c in df.columns if c.startswith(evidence.PREFIX)]
    spec = features.fit_spec(df.where("split = 'train'").select(*traffic))
    # what the features are made of is counted first, so that gates and features are those of distinct flows
    flows_ = posthoc.role_counts(df.select("key", "split", _target(), *traffic, *hints), ["y", *traffic, *hints], seeds, 0.2)
    rows = evidence.add_gates(flows_, evidence.NETFLOW_HINTS, evidence.RELIABILITY["netflow"])
    names = [c for c in rows.columns if c.startswith(evidence.PREFIX)]
    rows = features.transform(rows, spec, "traffic").select("y", "member", "valid", "test", X.q(evidence.PREFIX + "source_gate_mean").alias("gate"), F.concat("traffic", F.array(*[X.q(c) for c in names])).alias("features"))
    n = len(features.feature_names(spec))
    return posthoc.counted_grid(rows, np.arange(n + len(names)) >= n, 3, seeds)


@query("st1_stream_family_cap", "SELECT event_type, least(100, count(*)) AS n FROM events GROUP BY 1")
def st1(spark, sf_dir):
    """A file stream of events through the stateful cap; the counts equal those of a batch cap."""
    import uuid

    from ..streaming.caps import stream_family_cap

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    run = uuid.uuid4().hex
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", False).parquet(f"{sf_dir}/*")
        capped = stream_family_cap(stream.select("event_id", "event_type"), "event_type", 100)
        done = capped.writeStream.format("parquet").option("path", f"{root}/st1-{run}").option("checkpointLocation", f"{root}/st1-state-{run}").trigger(availableNow=True).start()
        done.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("event_id long, event_type string").parquet(f"{root}/st1-{run}").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
