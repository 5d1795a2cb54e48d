"""Queries over benchmark runs and model catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bench as b
from ..sources import views as v


def _part(s, d):
    return v.table(s, d, "part").select(F.col("p_partkey").alias("variant_id"), F.col("p_type").alias("category"), (F.col("p_size") * 1000).cast("long").alias("size"), (F.col("p_partkey") * 7919 % 10007 * 100_000 + F.col("p_partkey")).alias("position"), "p_brand")


def _stats(s, d):
    x = v.bench_runs(s, d).groupBy("case_id").agg(F.stddev_samp("seconds").alias("sd_s"), F.max("memory").alias("m"))
    n = F.col("m").cast("long")
    return x.select("case_id", (F.col("sd_s") / 20).alias("sd_s"), (n % 2 == 0).alias("on_battery"), (n % 3 == 0).alias("low_power"), F.lit("nominal").alias("thermal_before"), F.when(n % 5 == 0, "serious").otherwise("nominal").alias("thermal_after"), (n % 7 == 0).alias("cold"), F.when(n % 2 == 1, "debug").otherwise("release").alias("build"), (n % 4 > 0).alias("isolated"), (n % 6 > 0).alias("materialized"))


def _cases(s, d):
    o = v.table(s, d, "orders")
    k, t = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    return o.select(k.alias("case_id"), t.alias("before_load"), (t + k % 1000 - 500).alias("after_load"), (k % 5 * 500000).alias("active_bytes"), (k % 5 * 500000 + t).alias("peak_bytes"), (t % 100).alias("user_s"), (k % 10).alias("system_s"), (k % 50).alias("wall_s"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("backend"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("finished_at"))


def _ladder(s, d):
    l = v.table(s, d, "lineitem")  # noqa: E741
    return l.groupBy((F.col("l_suppkey") % 50).alias("model"), F.element_at(F.array(*map(F.lit, ("fp32", "fp16", "int8", "int4"))), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("precision")).agg(F.median("l_quantity").alias("seconds"), F.max("l_extendedprice").alias("memory"), F.sum("l_quantity").alias("size"))


def _files(s, d):
    x = v.table(s, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").cast("binary").alias("content"))
    pins = x.where("file % 23 <> 0").select("file", F.when(F.col("file") % 17 == 0, F.sha2(F.col("file").cast("string"), 256)).otherwise(F.sha2("content", 256)).alias("expected"))
    return x, pins


QUERIES = {
    "timing_stats": lambda s, d: b.timing_stats(v.bench_runs(s, d)).select("case_id", "min_s", "median_s", *(F.round(c, 6).alias(c) for c in ("mean_s", "sd_s", "rtf", "best_rtf"))),
    "exact_median": lambda s, d: b.exact_median(v.table(s, d, "lineitem"), "l_returnflag", "l_extendedprice", 500, 16),
    "memory_stats": lambda s, d: b.memory_stats(_cases(s, d)).select("case_id", "load_delta", "materialized", "activations"),
    "cpu_stats": lambda s, d: b.cpu_stats(_cases(s, d)).select("case_id", F.when(~F.isnan("utilization"), F.round("utilization", 6)).alias("utilization"), F.isnan("utilization").alias("unknown")),
    "precision_ladder": lambda s, d: b.precision_ladder(_ladder(s, d)).select("model", "precision", *(F.round(c, 6).alias(c) for c in ("speed", "memory", "size"))),
    "quality_flags": lambda s, d: b.quality_flags(_stats(s, d)).select("case_id", F.concat_ws(",", "flags").alias("flags")),
    "select_cases": lambda s, d: b.select_cases(_cases(s, d).withColumn("case_id", F.concat(F.lit("Case-"), F.col("case_id").cast("string"))), ["URGENT", "case-77", "p"]).select("case_id", "category", "backend"),
    "redact_paths": lambda s, d: v.table(s, d, "customer").select("c_custkey", b.redact(F.concat(F.lit("/Users/me/out "), F.col("c_name"), F.lit(" on studio.local, /home/bob/x and /Users/eve/y")), "/Users/me", "studio.local").alias("line")),
    "headroom": lambda s, d: v.table(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), b.headroom(F.col("o_totalprice"), F.lit(200000.0)).alias("verdict")),
    "latest_runs": lambda s, d: b.latest_runs(_cases(s, d).select(F.col("cust").alias("case_id"), F.col("case_id").alias("run_id"), "finished_at")).select("case_id", "run_id"),
    "catalog_summary": lambda s, d: b.catalog_summary(_part(s, d)),
    "catalog_models": lambda s, d: b.catalog_models(v.table(s, d, "supplier").select(F.col("s_suppkey").alias("model_id"), F.col("s_suppkey").alias("position"), F.col("s_nationkey").alias("category")), _part(s, d).withColumn("model_id", F.col("variant_id") % 120)),
    "catalog_lookup": lambda s, d: b.find_variants(_part(s, d).unionByName(_part(s, d).withColumns({"position": F.col("position") + 10**9, "size": F.lit(-1).cast("long")})), v.table(s, d, "lineitem").select((F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 10**9).otherwise(0)).alias("variant_id")).distinct()),
    "catalog_counts": lambda s, d: b.catalog_counts(v.table(s, d, "supplier"), _part(s, d), v.table(s, d, "orders")),
    "package_sizes": lambda s, d: b.package_sizes(v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("package_id"), (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 10**9).otherwise(0)).alias("variant_id")), _part(s, d)),
    "check_sizes": lambda s, d: b.check_sizes(
        v.table(s, d, "supplier").select(F.col("s_suppkey").alias("variant_id"), F.concat(F.lit("repo"), (F.col("s_suppkey") % 12).cast("string")).alias("repo"), F.array(F.concat(F.lit("w/"), (F.col("s_suppkey") % 10).cast("string"), F.lit("/*.bin")), F.lit("cfg/**.json")).alias("globs"), F.when(F.col("s_suppkey") % 11 > 0, F.col("s_suppkey") * 300).alias("size")),
        v.table(s, d, "part").select(F.concat(F.lit("repo"), (F.col("p_partkey") % 10).cast("string")).alias("repo"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("cfg/a/"), F.col("p_partkey").cast("string"), F.lit(".json"))).otherwise(F.concat(F.lit("w/"), (F.col("p_partkey") % 7).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".bin"))).alias("path"), F.col("p_size").cast("long").alias("bytes")), 0.05),
    "verify_files": lambda s, d: b.verify_files(*_files(s, d)).groupBy("status").agg(F.count("*").alias("n"), F.min("file").alias("first")),
    "reconcile_versions": lambda s, d: b.reconcile(
        v.table(s, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("name"), (F.col("c_custkey") % 5).cast("string").alias("version")),
        v.table(s, d, "orders").where("o_custkey % 11 <> 0").select(F.col("o_custkey").alias("name"), F.when(F.col("o_custkey") % 13 == 0, "x").otherwise((F.col("o_custkey") % 5).cast("string")).alias("version"), (F.col("o_custkey") % 2).alias("k")).where("k = 0").select("name", "version").distinct().unionByName(v.table(s, d, "customer").where("c_custkey % 17 = 0").select(F.col("c_custkey").alias("name"), F.lit("y").alias("version")))),
}

_R = v.using("runs")
#: Where a variant is listed, which isn't by its id.
_POSITION = "p_partkey * 7919 % 10007 * 100000 + p_partkey"
_C = "WITH c AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS t, * FROM orders)"
_F = "WITH f AS (SELECT doc_id, sha256(text) AS actual, CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN sha256(CAST(doc_id AS VARCHAR)) ELSE sha256(text) END AS expected FROM documents)"
SQL = {
    "timing_stats": f"{_R} SELECT case_id, min(seconds) AS min_s, median(seconds) AS median_s, round(avg(seconds), 6) AS mean_s, round(coalesce(stddev_samp(seconds), 0), 6) AS sd_s, round(30 / median(seconds), 6) AS rtf, round(30 / min(seconds), 6) AS best_rtf FROM runs GROUP BY case_id",
    "exact_median": "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1",
    "memory_stats": f"{_C} SELECT k AS case_id, greatest(0, k % 1000 - 500) AS load_delta, k % 5 * 500000 >= 1048576 AS materialized, CASE WHEN k % 5 * 500000 >= 1048576 THEN t END AS activations FROM c",
    "cpu_stats": f"{_C} SELECT k AS case_id, CASE WHEN k % 50 > 0 THEN round((t % 100 + k % 10) / (k % 50)::DOUBLE, 6) END AS utilization, k % 50 = 0 AS unknown FROM c",
    "precision_ladder": """WITH x AS (SELECT l_suppkey % 50 AS model, ['fp32', 'fp16', 'int8', 'int4'][l_linenumber % 4 + 1] AS precision, median(l_quantity) AS seconds, max(l_extendedprice) AS memory, sum(l_quantity) AS size FROM lineitem GROUP BY ALL)
SELECT x.model, x.precision, round(b.seconds / x.seconds, 6) AS speed, round(x.memory / b.memory, 6) AS memory, round(x.size / b.size, 6) AS size FROM x JOIN x b ON x.model = b.model AND b.precision = 'fp32'""",
    "quality_flags": f"""{_R}, q AS (SELECT case_id, stddev_samp(seconds) / 20 AS sd, CAST(trunc(max(memory)) AS BIGINT) AS n FROM runs GROUP BY case_id)
SELECT case_id, array_to_string(list_filter([CASE WHEN n % 2 = 0 THEN 'battery' END, CASE WHEN n % 3 = 0 THEN 'low_power' END, CASE WHEN n % 5 = 0 THEN 'throttled' END, CASE WHEN n % 7 = 0 THEN 'cold_weights' END, CASE WHEN n % 2 = 1 THEN 'debug_build' END, CASE WHEN n % 4 = 0 THEN 'shared_process' END, CASE WHEN n % 6 = 0 THEN 'lazy_weights' END, CASE WHEN sd > 0.5 THEN 'contaminated' END], lambda x: x IS NOT NULL), ',') AS flags FROM q""",
    "select_cases": "SELECT * FROM (SELECT 'Case-' || o_orderkey AS case_id, o_orderpriority AS category, o_orderstatus AS backend FROM orders) WHERE lower(category) LIKE '%urgent%' OR lower(backend) LIKE '%urgent%' OR lower(case_id) LIKE '%case-77%' OR lower(category) LIKE '%p%' OR lower(backend) LIKE '%p%'",
    "redact_paths": "SELECT c_custkey, '~/out ' || c_name || ' on <host>, /home/<user>/x and /Users/<user>/y' AS line FROM customer",
    "headroom": "SELECT o_orderkey AS case_id, CASE WHEN o_totalprice > 200000 THEN 'insufficient' WHEN o_totalprice > 100000 THEN 'tight' ELSE 'fits' END AS verdict FROM orders",
    "latest_runs": "SELECT o_custkey AS case_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY 1",
    "catalog_summary": f"SELECT p_type AS category, count(*) AS n, CAST(sum(p_size * 1000) AS BIGINT) AS bytes, arg_min(p_partkey, {_POSITION}) AS default_id, arg_min(p_partkey, (p_size, {_POSITION})) AS smallest_id FROM part GROUP BY 1",
    "catalog_models": f"""WITH p AS (SELECT p_partkey % 120 AS model_id, count(*) AS n, CAST(sum(p_size * 1000) AS BIGINT) AS bytes, arg_min(p_partkey, {_POSITION}) AS default_id, arg_min(p_partkey, (p_size, {_POSITION})) AS smallest_id FROM part GROUP BY 1)
SELECT s_suppkey AS model_id, s_nationkey AS category, coalesce(n, 0) AS n, coalesce(bytes, 0) AS bytes, default_id, smallest_id FROM supplier LEFT JOIN p ON s_suppkey = model_id""",
    "catalog_lookup": "SELECT k AS variant_id, p_type AS category, CAST(p_size * 1000 AS BIGINT) AS size FROM (SELECT DISTINCT l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS k FROM lineitem) LEFT JOIN part ON k = p_partkey",
    "catalog_counts": "SELECT (SELECT count(*) FROM supplier) AS models, count(*) AS variants, CAST(sum(p_size * 1000) AS BIGINT) AS bytes, (SELECT count(*) FROM orders) AS packages FROM part",
    "package_sizes": "SELECT l_orderkey AS package_id, CAST(sum(coalesce(p_size * 1000, 0)) AS BIGINT) AS bytes FROM (SELECT l_orderkey, l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS k FROM lineitem) LEFT JOIN part ON k = p_partkey GROUP BY 1",
    "check_sizes": """WITH f AS (SELECT 'repo' || p_partkey % 10 AS repo, CASE WHEN p_partkey % 3 = 0 THEN 'cfg/a/' || p_partkey || '.json' ELSE 'w/' || p_partkey % 7 || '/' || p_partkey || '.bin' END AS path, p_size AS bytes FROM part),
m AS (SELECT s_suppkey, 'repo' || s_suppkey % 12 AS repo, CASE WHEN s_suppkey % 11 > 0 THEN s_suppkey * 300 END AS size FROM supplier),
x AS (SELECT m.s_suppkey, sum(bytes) AS actual FROM m JOIN f ON m.repo = f.repo AND (regexp_matches(path, '^cfg/.*\\.json$') OR regexp_matches(path, '^w/' || s_suppkey % 10 || '/[^/]*\\.bin$')) GROUP BY 1)
SELECT m.s_suppkey AS variant_id, CAST(coalesce(actual, 0) AS BIGINT) AS actual, CASE WHEN s_suppkey % 12 > 9 THEN 'unreachable' WHEN size IS NULL THEN 'not in catalog' WHEN actual IS NULL THEN 'matches nothing' WHEN actual = size THEN 'ok' WHEN abs(actual - size) <= 0.05 * actual THEN 'within tolerance' ELSE 'mismatch' END AS status FROM m LEFT JOIN x USING (s_suppkey)""".replace("\\\\", "\\"),
    "verify_files": f"{_F} SELECT CASE WHEN expected IS NULL THEN 'unpinned' WHEN expected = actual THEN 'verified' ELSE 'mismatch' END AS status, count(*) AS n, min(doc_id) AS first FROM f GROUP BY 1",
    "reconcile_versions": """WITH d AS (SELECT DISTINCT o_custkey AS name, CASE WHEN o_custkey % 13 = 0 THEN 'x' ELSE CAST(o_custkey % 5 AS VARCHAR) END AS version FROM orders WHERE o_custkey % 11 <> 0 AND o_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'y' FROM customer WHERE c_custkey % 17 = 0),
g AS (SELECT name, count(*) AS n, min(version) AS documented FROM d GROUP BY 1), r AS (SELECT c_custkey AS name, CAST(c_custkey % 5 AS VARCHAR) AS resolved FROM customer WHERE c_custkey % 7 <> 0)
SELECT * FROM (SELECT name, CASE WHEN documented IS NULL THEN 'undocumented' WHEN resolved IS NULL THEN 'stale' WHEN n > 1 THEN 'duplicate' WHEN resolved <> documented THEN 'mismatch' END AS problem FROM r FULL OUTER JOIN g USING (name)) WHERE problem IS NOT NULL""",
}
