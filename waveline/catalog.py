"""Query catalog: name -> (spark, sf_dir) -> DataFrame, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline import plans
from waveline.operators import exact, generators, haar, ids, metrics, reconstruct, sampling
from waveline.sources import logs, storage, tables, text

#: Levels of the domains: part keys, supplier keys, event values.
LP, LS, LE = 15, 10, 6
K, EPS, M = 30, 0.02, 8
ZIPF_DOMAIN, ZIPF_N = 1000, 100_000

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.central_topk(tables.parts(spark, sf_dir), 8, K)


# SQL pieces: relations as subqueries

P = "(SELECT l_partkey + 1 AS key, l_linenumber::BIGINT AS node FROM lineitem)"
S = "(SELECT l_suppkey + 1 AS key, l_linenumber::BIGINT AS node FROM lineitem)"
E = "(SELECT least(floor(value / 8)::BIGINT + 1, 64) AS key, user_id % 8 AS node, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS pos FROM events)"
EPS_SQL = f"cast({EPS} AS DOUBLE)"
EM_SQL = f"cast({sampling.em(EPS, M)!r} AS DOUBLE)"


def _freq(src: str) -> str:
    return f"(SELECT key, count(*) AS freq FROM {src} GROUP BY key)"


def _local(src: str) -> str:
    return f"(SELECT node, key, count(*) AS freq FROM {src} GROUP BY node, key)"


def _haar(src: str, levels: int, by: str = "") -> str:
    size = f"(1::BIGINT << (CASE WHEN l = 0 THEN {levels} ELSE l END)::INT)::DOUBLE"
    idx = f"CASE WHEN l = 0 THEN 1 ELSE (1::BIGINT << ({levels} - l)::INT) + ((key - 1) >> l::INT) + 1 END"
    part = f"CASE WHEN l = 0 OR ((key - 1) >> greatest(l - 1, 0)::INT) & 1 = 1 THEN freq / {size} ELSE -freq / {size} END"
    return f"(SELECT {by} idx, sum(c) AS coef FROM (SELECT {by} {idx} AS idx, {part} AS c FROM {src}, range(0, {levels + 1}) t(l)) GROUP BY {by} idx HAVING sum(c) <> 0 OR idx = 1)"


def _top(src: str, k: int = K) -> str:
    return f"(SELECT idx, coef FROM {src} ORDER BY abs(coef) DESC, idx LIMIT {k})"


def _inverse(src: str, levels: int) -> str:
    idx = f"CASE WHEN l = 0 THEN 1 ELSE (1::BIGINT << ({levels} - l)::INT) + ((key - 1) >> l::INT) + 1 END"
    sign = "CASE WHEN l = 0 OR ((key - 1) >> greatest(l - 1, 0)::INT) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
    return f"(SELECT key, sum(coalesce(coef, 0) * s) + 0.0 AS value FROM (SELECT key, {idx} AS idx, {sign} AS s FROM range(1, {(1 << levels) + 1}) d(key), range(0, {levels + 1}) t(l)) p LEFT JOIN {src} c USING (idx) GROUP BY key)"


def _round(src: str) -> str:
    return f"(SELECT key, floor(value + 0.5)::BIGINT AS freq FROM {src})"


# frequency tables and transforms


@_query(f"SELECT * FROM {_freq(P)}")
def key_frequency(spark, sf_dir):
    return exact.frequency(tables.parts(spark, sf_dir))


@_query(f"SELECT * FROM {_freq(E)}")
def key_frequency_events(spark, sf_dir):
    return exact.frequency(tables.events(spark, sf_dir, positions=False))


@_query(f"SELECT * FROM {_haar(_freq(P), LP)}")
def haar_all(spark, sf_dir):
    return haar.coefficients(exact.frequency(tables.parts(spark, sf_dir)), LP)


@_query(f"SELECT * FROM {_top(_haar(_freq(P), LP))}")
def haar_topk(spark, sf_dir):
    return exact.central_topk(tables.parts(spark, sf_dir), LP, K)


@_query(f"SELECT * FROM {_top(_haar(_freq(S), LS))}")
def haar_topk_suppkey(spark, sf_dir):
    return exact.central_topk(tables.suppliers(spark, sf_dir), LS, K)


@_query(f"SELECT * FROM {_local(P)}")
def local_frequency(spark, sf_dir):
    return exact.local_frequency(tables.parts(spark, sf_dir))


@_query(f"SELECT * FROM {_haar(_local(S), LS, 'node,')}")
def local_coefficients(spark, sf_dir):
    return exact.local_coefficients(tables.suppliers(spark, sf_dir), LS)


@_query(f"SELECT * FROM {_top(_haar(_freq(P), LP))}")
def local_coef_topk(spark, sf_dir):
    return exact.local_topk(tables.parts(spark, sf_dir), LP, K)


# the three rounds

_LOCAL = f"local AS (SELECT * FROM {_haar(_local(S), LS, 'node,')})"
_SENT = f"""sent AS (
  SELECT * FROM (SELECT node, idx, coef, -1 AS band, row_number() OVER (PARTITION BY node ORDER BY coef, idx) AS place FROM local WHERE coef < 0) WHERE place <= {K}
  UNION ALL SELECT * FROM (SELECT node, idx, coef, 1 AS band, row_number() OVER (PARTITION BY node ORDER BY coef DESC, idx) AS place FROM local WHERE coef > 0) WHERE place <= {K})"""
_BOUNDS = f"""bounds AS (
  SELECT node, coalesce(max(CASE WHEN place = {K} AND band = 1 THEN coef END), 0) AS hi, coalesce(min(CASE WHEN place = {K} AND band = -1 THEN coef END), 0) AS lo FROM sent GROUP BY node)"""
_TAU = "CASE WHEN upper > 0 AND lower < 0 THEN 0 ELSE least(abs(upper), abs(lower)) END"
_TABLE = f"""bound_table AS (SELECT *, {_TAU} AS tau FROM (
  SELECT idx, sum(coef) AS partial_sum, sum(coef) + ((SELECT sum(hi) FROM bounds) - sum(hi)) AS upper, sum(coef) + ((SELECT sum(lo) FROM bounds) - sum(lo)) AS lower
  FROM sent JOIN bounds USING (node) GROUP BY idx))"""
_BOUND = f"bound AS (SELECT CASE WHEN count(*) = {K} THEN min(tau) ELSE 0 END AS bound FROM (SELECT tau FROM bound_table ORDER BY tau DESC LIMIT {K}))"
_M = "(SELECT count(DISTINCT node) FROM local)"
_MORE = f"more AS (SELECT node, idx, coef FROM local ANTI JOIN sent USING (node, idx) WHERE abs(coef) * {_M} >= (SELECT bound FROM bound))"
_SECOND = f"""second AS (SELECT idx, upper, lower, {_TAU} AS tau FROM (
  SELECT idx, sum(coef) * {_M} + ({_M} - count(*)) * (SELECT bound FROM bound) AS upper, sum(coef) * {_M} - ({_M} - count(*)) * (SELECT bound FROM bound) AS lower
  FROM (SELECT idx, coef FROM sent UNION ALL SELECT idx, coef FROM more) GROUP BY idx)),
bound2 AS (SELECT CASE WHEN count(*) = {K} THEN min(tau) ELSE 0 END AS bound FROM (SELECT tau FROM second ORDER BY tau DESC LIMIT {K}))"""
_ROUNDS = f"WITH {_LOCAL}, {_SENT}, {_BOUNDS}, {_TABLE}, {_BOUND}, {_MORE}, {_SECOND}"


def _rounds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    keys = tables.suppliers(spark, sf_dir)
    local = exact.local_coefficients(keys, LS)
    nodes = keys.select("node").distinct()
    m = nodes.count()
    sent = exact.two_sided(local, K)
    table = exact.bound_table(sent, exact.node_bounds(nodes, sent, K))
    bound = exact.kth_bound(table, K)
    rest = exact.unsent(local, exact.cuts(sent, K))
    more = exact.round2(rest, bound, m)
    wanted = exact.candidates(sent, more, bound, m, K)
    return {"sent": sent, "table": table, "bound": bound, "more": more, "candidates": wanted, "last": exact.round3(rest, wanted, bound, m)}


@_query(f"{_ROUNDS} SELECT node, idx, coef, band::TINYINT AS band FROM sent")
def two_sided_local_topk(spark, sf_dir):
    return _rounds(spark, sf_dir)["sent"].drop("place")


@_query(f"{_ROUNDS} SELECT * FROM bound_table")
def bound_table(spark, sf_dir):
    return _rounds(spark, sf_dir)["table"]


@_query(f"{_ROUNDS} SELECT bound FROM bound")
def kth_bound(spark, sf_dir):
    return _rounds(spark, sf_dir)["bound"]


@_query(f"{_ROUNDS} SELECT * FROM more")
def round2_messages(spark, sf_dir):
    return _rounds(spark, sf_dir)["more"]


@_query(f"{_ROUNDS} SELECT idx FROM second WHERE greatest(abs(upper), abs(lower)) >= (SELECT bound FROM bound2)")
def candidates(spark, sf_dir):
    return _rounds(spark, sf_dir)["candidates"].select("idx")


_WANTED = "wanted AS (SELECT idx FROM second WHERE greatest(abs(upper), abs(lower)) >= (SELECT bound FROM bound2))"


@_query(f"{_ROUNDS}, {_WANTED} SELECT node, idx, coef FROM local ANTI JOIN sent USING (node, idx) WHERE abs(coef) * {_M} < (SELECT bound FROM bound) AND coef <> 0 AND idx IN (SELECT idx FROM wanted)")
def round3_messages(spark, sf_dir):
    return _rounds(spark, sf_dir)["last"]


@_query(f"SELECT * FROM {_top(_haar(_freq(P), LP))}")
def exact_topk_3phase(spark, sf_dir):
    return exact.three_round_topk(tables.parts(spark, sf_dir), LP, K)


# sampling

_RATE = f"e AS (SELECT * FROM {E}), rate AS (SELECT greatest(1, floor({EPS_SQL} * {EPS_SQL} * count(*) + 0.5)::BIGINT) AS step FROM e), r AS (SELECT step, 1.0::DOUBLE / step::DOUBLE AS p FROM rate)"
_SAMPLED = f"{_RATE}, sampled AS (SELECT key, node, pos, p FROM e, r WHERE pos % step = 0), pairs AS (SELECT node, key, p, count(*) AS c FROM sampled GROUP BY node, key, p)"
_IMPROVED = f"{_SAMPLED}, improved AS (SELECT node, key, c, p FROM (SELECT *, sum(c) OVER (PARTITION BY node) AS tj FROM pairs) WHERE c >= {EPS_SQL} * tj)"
_COIN = f"('0x' || substr(md5('{sampling.SEED}|' || node || '|' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_TWO = f"{_SAMPLED}, two AS (SELECT node, key, CASE WHEN c >= 1.0::DOUBLE / {EM_SQL} THEN c ELSE 0 END AS c, p FROM pairs WHERE c >= 1.0::DOUBLE / {EM_SQL} OR {_COIN} <= {EM_SQL} * c)"
_BASIC_E = "(SELECT key, floor(count(*) / any_value(p) + 0.5)::BIGINT AS freq FROM sampled GROUP BY key)"
_IMPROVED_E = "(SELECT key, floor(sum(c) / any_value(p) + 0.5)::BIGINT AS freq FROM improved GROUP BY key)"
_MARKS = f"count_if(c = 0) / {EM_SQL}"
_TWO_E = f"(SELECT key, trunc((sum(c) + {_MARKS}) / any_value(p))::BIGINT AS freq FROM two GROUP BY key)"
_TWO_V = f"(SELECT key, trunc((sum(c) + floor({_MARKS} + 0.5)) / any_value(p))::BIGINT AS freq FROM two GROUP BY key)"
_STATS = "SELECT node, sum(n)::BIGINT AS records, count(*) AS items FROM (SELECT node, key, count(*) AS n FROM e GROUP BY node, key) GROUP BY node"
_SOME = "SELECT node, sum(c)::BIGINT AS sampled, count(*) AS sampled_items FROM pairs GROUP BY node"


@_query(f"WITH {_SAMPLED} SELECT node, key, pos FROM sampled")
def systematic_sample(spark, sf_dir):
    return sampling.systematic(tables.events(spark, sf_dir), EPS).select("node", "key", "pos")


@_query(f"WITH {_SAMPLED} SELECT * FROM {_BASIC_E}")
def basic_estimate(spark, sf_dir):
    return sampling.basic_estimate(tables.events(spark, sf_dir), EPS)


@_query(f"WITH {_SAMPLED} SELECT * FROM {_top(_haar(_BASIC_E, LE))}")
def basic_topk(spark, sf_dir):
    return plans.synopsis(tables.events(spark, sf_dir), "basic", LE, K, EPS)


@_query(f"WITH {_IMPROVED} SELECT node, key, c FROM improved")
def improved_pairs(spark, sf_dir):
    return sampling.improved_pairs(tables.events(spark, sf_dir), EPS).drop("p")


@_query(f"WITH {_IMPROVED} SELECT * FROM {_IMPROVED_E}")
def improved_estimate(spark, sf_dir):
    return sampling.improved_estimate(tables.events(spark, sf_dir), EPS)


@_query(f"WITH {_IMPROVED} SELECT * FROM {_top(_haar(_IMPROVED_E, LE))}")
def improved_topk(spark, sf_dir):
    return plans.synopsis(tables.events(spark, sf_dir), "improved", LE, K, EPS)


@_query(f"WITH {_IMPROVED} SELECT node, records, items, sampled, sampled_items, {EPS_SQL} * sampled AS threshold, coalesce(passed, 0) AS passed FROM ({_STATS}) LEFT JOIN ({_SOME}) USING (node) LEFT JOIN (SELECT node, count(*) AS passed FROM improved GROUP BY node) USING (node)")
def improved_stats(spark, sf_dir):
    return sampling.improved_statistics(tables.events(spark, sf_dir), EPS)


@_query(f"WITH {_TWO} SELECT node, key, c FROM two")
def twolevel_pairs(spark, sf_dir):
    return sampling.twolevel_pairs(tables.events(spark, sf_dir), EPS, M).drop("p")


@_query(f"WITH {_TWO} SELECT * FROM {_TWO_E}")
def twolevel_estimate(spark, sf_dir):
    return sampling.twolevel_estimate(tables.events(spark, sf_dir), EPS, M)


@_query(f"WITH {_TWO} SELECT * FROM {_TWO_V}")
def twolevel_variant_estimate(spark, sf_dir):
    return sampling.twolevel_estimate(tables.events(spark, sf_dir), EPS, M, variant=True)


@_query(f"WITH {_TWO} SELECT * FROM {_top(_haar(_TWO_E, LE))}")
def twolevel_topk(spark, sf_dir):
    return plans.synopsis(tables.events(spark, sf_dir), "twolevel", LE, K, EPS, M)


@_query(f"WITH {_TWO} SELECT * FROM {_top(_haar(_TWO_V, LE))}")
def twolevel_variant_topk(spark, sf_dir):
    return plans.synopsis(tables.events(spark, sf_dir), "twolevel_variant", LE, K, EPS, M)


@_query(f"WITH {_TWO} SELECT node, records, items, sampled, sampled_items, 1.0::DOUBLE / {EM_SQL} AS threshold, coalesce(passed, 0) AS passed, coalesce(passed_2nd, 0) AS passed_2nd FROM ({_STATS}) LEFT JOIN ({_SOME}) USING (node) LEFT JOIN (SELECT node, count_if(c > 0)::BIGINT AS passed, count_if(c = 0)::BIGINT AS passed_2nd FROM two GROUP BY node) USING (node)")
def twolevel_stats(spark, sf_dir):
    return sampling.twolevel_statistics(tables.events(spark, sf_dir), EPS, M)


# reconstruction and error


@_query(f"SELECT * FROM {_inverse(_haar(_freq(S), LS), LS)}")
def reconstruct_full(spark, sf_dir):
    return reconstruct.frequencies(haar.coefficients(exact.frequency(tables.suppliers(spark, sf_dir)), LS), LS)


@_query(f"SELECT * FROM {_inverse(_top(_haar(_freq(S), LS)), LS)}")
def reconstruct_topk(spark, sf_dir):
    return reconstruct.frequencies(exact.central_topk(tables.suppliers(spark, sf_dir), LS, K), LS)


@_query(f"SELECT * FROM {_round(_inverse(_top(_haar(_freq(S), LS)), LS))}")
def reconstruct_rounded(spark, sf_dir):
    return reconstruct.rounded(reconstruct.frequencies(exact.central_topk(tables.suppliers(spark, sf_dir), LS, K), LS))


_Z = f"(SELECT idx - 1 AS z, (length(bin(idx - 1)) - 1) AS depth FROM {_top(_haar(_freq(S), LS))} WHERE idx > 1)"
_W = f"(SELECT (z - (1::BIGINT << depth::INT)) * (1::BIGINT << ({LS} - depth)::INT) + 1 AS start, (1::BIGINT << ({LS} - depth)::INT) AS size FROM {_Z})"


@_query(f"""WITH b AS (SELECT DISTINCT lo FROM (SELECT 1::BIGINT AS lo UNION ALL SELECT start FROM {_W} UNION ALL SELECT start + size // 2 FROM {_W} UNION ALL SELECT start + size FROM {_W}) WHERE lo <= {1 << LS})
SELECT lo, coalesce(lead(lo) OVER (ORDER BY lo) - 1, {1 << LS})::BIGINT AS hi, value FROM b JOIN {_inverse(_top(_haar(_freq(S), LS)), LS)} ON key = lo""")
def histogram_segments(spark, sf_dir):
    return reconstruct.segments(exact.central_topk(tables.suppliers(spark, sf_dir), LS, K), LS)


_MADE = _round(_inverse(_top(_haar(_freq(S), LS)), LS))


def _sse_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keys = tables.suppliers(spark, sf_dir)
    return exact.frequency(keys), reconstruct.rounded(reconstruct.frequencies(exact.central_topk(keys, LS, K), LS))


@_query(f"SELECT sum((a.freq - b.freq) * (a.freq - b.freq))::BIGINT AS sse FROM {_freq(S)} a JOIN {_MADE} b USING (key)")
def sse_join(spark, sf_dir):
    return metrics.sse(*_sse_tables(spark, sf_dir))


@_query(f"SELECT sum((a.freq - b.freq) * (a.freq - b.freq))::BIGINT AS sse FROM {_freq(S)} a JOIN {_MADE} b USING (key)")
def sse_group(spark, sf_dir):
    return metrics.sse_grouped(*_sse_tables(spark, sf_dir))


def _method_sql(name: str, estimate: str) -> str:
    made = _round(_inverse(_top(_haar(estimate, LE), 10), LE))
    return f"SELECT '{name}' AS method, sum((coalesce(a.freq, 0) - coalesce(b.freq, 0)) ** 2)::BIGINT AS sse FROM {_freq('e')} a FULL JOIN {made} b USING (key)"


@_query(
    f"WITH {_TWO}, improved AS (SELECT node, key, c, p FROM (SELECT *, sum(c) OVER (PARTITION BY node) AS tj FROM pairs) WHERE c >= {EPS_SQL} * tj) "
    + " UNION ALL ".join(_method_sql(n, q) for n, q in (("central", _freq("e")), ("basic", _BASIC_E), ("improved", _IMPROVED_E), ("twolevel", _TWO_E)))
)
def sse_per_method(spark, sf_dir):
    keys = tables.events(spark, sf_dir)
    out = None
    for method in ("central", "basic", "improved", "twolevel"):
        one = plans.error(keys, plans.synopsis(keys, method, LE, 10, EPS, M), LE).select(F.lit(method).alias("method"), "sse")
        out = one if out is None else out.unionAll(one)
    return out


# preparation, text forms and generators


@_query("SELECT o_custkey, o_orderpriority, dense_rank() OVER (ORDER BY o_custkey, o_orderpriority) AS id FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)")
def dense_ids(spark, sf_dir):
    return ids.dense_ids(tables.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"])


@_query("SELECT o_orderstatus, string_agg(id::VARCHAR, ',' ORDER BY o_orderkey) AS line FROM (SELECT *, dense_rank() OVER (ORDER BY o_custkey, o_orderpriority) AS id FROM orders) GROUP BY o_orderstatus")
def id_stream_per_file(spark, sf_dir):
    return ids.id_lines(tables.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus", ["o_orderkey"])


@_query(f"SELECT node, key, count(*) AS freq FROM {S} GROUP BY node, key")
def tokenize_keys(spark, sf_dir):
    # frequencies have no domain: as in the SQL, every key counts
    return exact.local_frequency(text.keys_of_lines(text.lines_of_keys(tables.suppliers(spark, sf_dir), ("node",))))


@_query(f"SELECT * FROM {_freq(P)}")
def pair_text_roundtrip(spark, sf_dir):
    return text.parse_pairs(text.format_pairs(exact.frequency(tables.parts(spark, sf_dir))), ("key", "freq"), "long")


@_query(f"SELECT * FROM {_top(_haar(_freq(S), LS))}")
def coefficient_text_roundtrip(spark, sf_dir):
    return text.parse_pairs(text.format_pairs(exact.central_topk(tables.suppliers(spark, sf_dir), LS, K).select("idx", "coef")), ("idx", "coef"), "double")


@_query("SELECT user_id::INT AS client_id, event_id::INT AS object_id, floor(epoch(ts))::INT AS ts, -(event_id % 7)::INT AS size, (event_id % 200 - 100)::TINYINT AS status FROM events")
def binary_log_roundtrip(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select(
        F.unix_timestamp("ts").alias("ts"), F.col("user_id").alias("client_id"), F.col("event_id").alias("object_id"), (-(F.col("event_id") % 7)).alias("size"),
        F.lit(1).alias("method"), (F.col("event_id") % 200 - 100).alias("status"), F.lit(3).alias("type"), F.lit(4).alias("server"),
    )
    blobs = logs.encode(rows).groupBy((F.col("object_id") % 64).alias("file")).agg(F.unhex(F.array_join(F.collect_list("record"), "")).alias("content"))
    return logs.decode(blobs).select("client_id", "object_id", "ts", "size", "status")


_ZIPF = f"""(SELECT rank, row_number() OVER (ORDER BY md5('42|' || rank), rank) AS key, floor({float(ZIPF_N)}::DOUBLE * (pow(rank::DOUBLE, -1.0::DOUBLE) / (SELECT sum(pow(r::DOUBLE, -1.0::DOUBLE)) FROM range(1, {ZIPF_DOMAIN + 1}) t(r))) + 0.5)::BIGINT AS freq FROM range(1, {ZIPF_DOMAIN + 1}) t(rank))"""


@_query(f"SELECT * FROM {_ZIPF}")
def zipf_frequencies(spark, sf_dir):
    return generators.zipf_frequencies(spark, ZIPF_DOMAIN, ZIPF_N)


@_query(f"SELECT key, freq FROM {_ZIPF} WHERE freq > 0")
def zipf_stream(spark, sf_dir):
    return exact.frequency(generators.repeat(generators.zipf_frequencies(spark, ZIPF_DOMAIN, ZIPF_N)))


@_query("SELECT * FROM (VALUES (1::BIGINT, 6.75::DOUBLE), (2, 0.25), (3, 2.5), (4, 5.0), (5, 1.0), (6, -1.0), (8, 2.0)) t(idx, coef)")
def toy_golden(spark, sf_dir):
    return exact.central_topk(generators.toy(spark), 3, 7)


# programs that go through files in the session's shared folder


@_query("SELECT DISTINCT sha1('a|' || o_orderstatus || '|' || o_orderpriority) AS node FROM orders")
def node_ids(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").select(text.node_id(F.lit("a"), "o_orderstatus", "o_orderpriority").alias("node")).distinct()


@_query(f"SELECT * FROM {_freq(S)}")
def key_file_roundtrip(spark, sf_dir):
    path = storage.fresh(spark)
    keys = tables.suppliers(spark, sf_dir)
    text.write_keys(keys, f"{path}/a.keys", mode="errorifexists")
    text.write_keys(keys, f"{path}/a.other")
    return exact.frequency(text.read_keys(spark, f"{path}/a.keys", glob="*.txt"))


@_query(f"SELECT * FROM {_freq(S)}")
def frequency_file_roundtrip(spark, sf_dir):
    path = storage.fresh(spark)
    text.write_pairs(exact.frequency(tables.suppliers(spark, sf_dir)), path, mode="errorifexists")
    return text.read_frequencies(spark, path)


@_query(f"SELECT * FROM {_freq(S)}")
def csv_roundtrip(spark, sf_dir):
    path = storage.fresh(spark)
    text.write_csv(exact.frequency(tables.suppliers(spark, sf_dir)), path)
    return text.read_csv(spark, path, "key long, freq long")


@_query(f"SELECT key, freq FROM {_round(_inverse(_top(_haar(_freq(S), LS)), LS))}")
def reconstruct_from_file(spark, sf_dir):
    path = storage.fresh(spark)
    text.write_pairs(exact.central_topk(tables.suppliers(spark, sf_dir), LS, K), f"{path}/coefficients")
    plans.reconstruct_file(spark, f"{path}/coefficients", LS, f"{path}/listing")
    return text.read_csv(spark, f"{path}/listing", "key long, freq long")


def _two_files(spark: SparkSession, sf_dir: str) -> str:
    path = storage.fresh(spark)
    for name, df in zip("ab", _sse_tables(spark, sf_dir), strict=True):
        text.write_pairs(df, f"{path}/{name}")
    return path


@_query(f"SELECT sum((a.freq - b.freq) * (a.freq - b.freq))::BIGINT AS sse FROM {_freq(S)} a JOIN {_MADE} b USING (key)")
def sse_from_files(spark, sf_dir):
    path = _two_files(spark, sf_dir)
    return plans.error_of_files(spark, f"{path}/a", f"{path}/b", f"{path}/sse")


@_query(f"SELECT sum((a.freq - b.freq) * (a.freq - b.freq))::BIGINT AS sse FROM {_freq(S)} a JOIN {_MADE} b USING (key)")
def sse_from_folder(spark, sf_dir):
    return plans.error_of_folder(spark, f"{_two_files(spark, sf_dir)}/*")


@_query("SELECT 'log' || (event_id % 3) AS log, user_id::INT AS client_id, event_id::INT AS object_id, floor(epoch(ts))::INT AS ts FROM events")
def requests_per_log(spark, sf_dir):
    path = storage.fresh(spark)
    rows = tables.table(spark, sf_dir, "events").select(F.concat(F.lit("log"), F.col("event_id") % 3).alias("log"), F.col("user_id").alias("client_id"), F.col("event_id").alias("object_id"), F.unix_timestamp("ts").alias("ts"))
    logs.write_requests(rows, path, by="log")
    return logs.read_requests(spark, path).select(F.col("log").cast("string").alias("log"), "client_id", "object_id", "ts")


@_query("SELECT client_id, object_id, dense_rank() OVER (ORDER BY client_id, object_id) AS id FROM (SELECT DISTINCT user_id::INT AS client_id, (event_id % 50)::INT AS object_id FROM events)")
def ids_of_requests(spark, sf_dir):
    path = storage.fresh(spark)
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("client_id"), (F.col("event_id") % 50).alias("object_id"), F.unix_timestamp("ts").alias("ts"))
    logs.write_requests(rows, path)
    return ids.dense_ids(logs.read_requests(spark, path), ["client_id", "object_id"])


@_query("SELECT o_orderstatus, o_orderkey, dense_rank() OVER (ORDER BY o_custkey, o_orderpriority) AS id FROM orders")
def id_stream_rows(spark, sf_dir):
    return ids.id_rows(tables.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus", ["o_orderkey"])


_TOTAL = f"(SELECT sum(pow(r::DOUBLE, -1.0::DOUBLE)) FROM range(1, {ZIPF_DOMAIN + 1}) t(r))"


@_query(f"SELECT rank, row_number() OVER (ORDER BY md5('42|' || rank), rank) AS key, round(pow(rank::DOUBLE, -1.0::DOUBLE) / {_TOTAL}, 9) AS p FROM range(1, {ZIPF_DOMAIN + 1}) t(rank)")
def zipf_listing(spark, sf_dir):
    path = storage.fresh(spark)
    text.write_ranks(generators.zipf_listing(spark, ZIPF_DOMAIN, ZIPF_N), path)
    return text.read_csv(spark, path, "rank long, key long, p double").withColumn("p", F.round("p", 9))
