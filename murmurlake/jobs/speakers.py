"""Queries over speaker embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embeddings as e
from ..sources import views as v


def _voices(s, d):
    return v.voices(s, d)[0]


def _refs(s, d):
    return v.voices(s, d)[1]


_NAMED = lambda s, d: _voices(s, d).select("voice_id", F.concat(F.element_at(F.array(*map(F.lit, "abefj")), (F.col("voice_id") % 5 + 1).cast("int")), F.when(F.col("label") % 2 == 0, "f").otherwise("m"), F.lit("_"), F.col("voice_id").cast("string")).alias("voice_name"))
_CLASSES = lambda s, d: v.events(s, d).groupBy(F.col("user_id").alias("rec")).agg(F.sort_array(F.collect_set((F.col("event_id") % 600).cast("int"))).alias("classes"))

QUERIES = {
    "pair_cosine": lambda s, d: v.vectors(s, d).alias("a").join(v.vectors(s, d).alias("b"), F.expr("a.vec_id + 1 = b.vec_id")).select(F.col("a.vec_id").alias("vec_id"), F.round(e.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("sim")),
    "top_k_voices": lambda s, d: e.top_k_voices(_refs(s, d), _voices(s, d), digits=6).withColumn("sim", F.round("sim", 6)),
    "identify_speakers": lambda s, d: e.identify(_refs(s, d), _voices(s, d), 0.2, 6).withColumn("sim", F.round("sim", 6)),
    "top_k_voices_pruned": lambda s, d: e.top_k_pruned(_refs(s, d), _voices(s, d), 5, 100)[0].withColumn("sim", F.round("sim", 6)),
    "blend_voices": lambda s, d: e.blend_voices(_refs(s, d), _voices(s, d)).select("ref_id", F.round("sim", 4).alias("sim"), F.explode(F.arrays_zip("voice_ids", "weights")).alias("x")).select("ref_id", "sim", F.col("x.voice_ids").alias("voice_id"), F.round("x.weights", 4).alias("weight")),
    "mix_voices": lambda s, d: e.mix_voices(v.table(s, d, "events").select((F.col("user_id") % 50).alias("mix_id"), (F.col("event_id") % 19 + 1 + F.col("event_id") % 7 * 20 + F.when(F.col("user_id") % 50 == 7, 10**9).otherwise(0)).alias("voice_id"), F.col("value").alias("weight")).groupBy("mix_id", "voice_id").agg(F.sum("weight").alias("weight")), _voices(s, d)).select("mix_id", F.posexplode_outer("embedding").alias("dim", "value"), "error").withColumn("value", F.round("value", 6)),
    "filter_voices": lambda s, d: e.filter_voices(_NAMED(s, d), "f", "english"),
    "centroids": lambda s, d: e.centroids(v.vectors(s, d)).select("label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 6)),
    "set_similarity": lambda s, d: e.set_similarity(v.vectors(s, d), v.vectors(s, d).withColumn("embedding", F.transform("embedding", lambda x, i: x + F.when((F.col("vec_id") + i) % 3 == 0, 0.3).otherwise(-0.1)))).withColumn("sim", F.round("sim", 6)),
    "multi_hot": lambda s, d: e.multi_hot(_CLASSES(s, d)).select("rec", F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("weights"), 9).alias("each")),
    "active_classes": lambda s, d: e.active_classes(e.multi_hot(_CLASSES(s, d))).select("rec", F.concat_ws(",", F.transform("classes", lambda x: x.cast("string"))).alias("classes")),
    "class_indices": lambda s, d: e.class_indices(v.table(s, d, "events").select(F.upper("event_type").alias("name")).distinct().unionByName(s.createDataFrame([("Nothing",)], "name string")), v.table(s, d, "events").select(F.col("event_type").alias("class_name"), (F.col("event_id") % 527).cast("int").alias("idx"))),
    "group_scores": lambda s, d: e.group_scores(v.events(s, d).select(F.col("user_id").alias("rec"), (F.col("event_id") % 527).cast("int").alias("class_idx"), (F.col("value") / 500).alias("score")), v.table(s, d, "embeddings").groupBy((F.col("vec_id") % 527).cast("int").alias("class_idx")).agg((F.min("label") % 7).alias("grp"))),
}

_B = v.using("voices")
_TOP = "top AS (SELECT ref_id, voice_id, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY sim DESC, voice_id) AS rank FROM (SELECT ref_id, voice_id, list_cosine_similarity(r.embedding, v.embedding) AS sim FROM refs r, voices v)) WHERE rank <= 5)"
SQL = {
    "top_k_voices_pruned": f"{_B}, {_TOP} SELECT ref_id, voice_id, round(sim, 6) AS sim, rank FROM top",
    # Projected gradient over inner products: g of the voices with each other, b of them with the reference.
    "blend_voices": f"""{_B.replace("WITH", "WITH RECURSIVE", 1)}, {_TOP},
v5 AS (SELECT t.ref_id, list(v.embedding ORDER BY rank) AS m, list(voice_id ORDER BY rank) AS ids FROM top t JOIN voices v USING (voice_id) GROUP BY t.ref_id),
p AS (SELECT ref_id, ids, len(m) AS k, list_transform(m, lambda x: list_transform(m, lambda y: list_dot_product(x, y))) AS g, list_transform(m, lambda x: list_dot_product(x, r.embedding)) AS b, list_dot_product(r.embedding, r.embedding) AS tt FROM v5 JOIN refs r USING (ref_id)),
s AS (SELECT ref_id, 0 AS i, list_transform(range(k), lambda j: 1.0::DOUBLE / k) AS w, CAST('inf' AS DOUBLE) AS was, FALSE AS done FROM p UNION ALL
  SELECT ref_id, i + 1, CASE WHEN stop THEN w ELSE list_transform(y, lambda z: greatest(z - level, 0.0::DOUBLE)) END, loss, stop FROM (
    SELECT *, list_max(list_transform(range(1, len(u) + 1), lambda j: (list_sum(u[1:j]) - 1) / j)) AS level FROM (
      SELECT *, list_reverse_sort(y) AS u FROM (
        SELECT *, list_transform(w, lambda z, j: z - 0.2::DOUBLE * (gw[j] - b[j])) AS y, abs(was - loss) < 1e-6 AS stop FROM (
          SELECT *, list_dot_product(w, gw) - 2 * list_dot_product(w, b) + tt AS loss FROM (
            SELECT s.ref_id, i, w, was, g, b, tt, list_transform(g, lambda row: list_dot_product(row, w)) AS gw FROM s JOIN p USING (ref_id) WHERE NOT done AND i < 100))))) AS q),
e AS (SELECT ref_id, list_transform(arg_max(w, i), lambda z: CASE WHEN z > 0.001 THEN z ELSE 0.0::DOUBLE END) AS w FROM s GROUP BY ref_id),
n AS (SELECT ref_id, ids, g, b, tt, list_transform(w, lambda z: z / list_sum(w)) AS w FROM e JOIN p USING (ref_id)),
f AS (SELECT ref_id, ids, w, list_dot_product(w, b) / sqrt(list_dot_product(w, list_transform(g, lambda row: list_dot_product(row, w))) * tt) AS sim FROM n)
SELECT ref_id, round(sim, 4) AS sim, voice_id, round(weight, 4) AS weight FROM (SELECT ref_id, sim, unnest(ids) AS voice_id, unnest(w) AS weight FROM f) WHERE weight > 0""",
    "pair_cosine": f"{_B} SELECT a.vec_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS sim FROM vecs a JOIN vecs b ON a.vec_id + 1 = b.vec_id",
    "top_k_voices": f"{_B} SELECT ref_id, voice_id, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY sim DESC, voice_id) AS rank FROM (SELECT ref_id, voice_id, round(list_cosine_similarity(r.embedding, v.embedding), 6) AS sim FROM refs r, voices v)) WHERE rank <= 5",
    "identify_speakers": f"{_B} SELECT ref_id, CASE WHEN sim >= 0.2 THEN CAST(voice_id AS VARCHAR) ELSE 'unknown' END AS speaker, greatest(sim, 0) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY sim DESC, voice_id) AS rank FROM (SELECT ref_id, voice_id, round(list_cosine_similarity(r.embedding, v.embedding), 6) AS sim FROM refs r, voices v)) WHERE rank = 1",
    "mix_voices": f"""{_B}, w AS (SELECT user_id % 50 AS mix_id, event_id % 19 + 1 + event_id % 7 * 20 + CASE WHEN user_id % 50 = 7 THEN 1000000000 ELSE 0 END AS voice_id, sum(value) AS weight FROM events GROUP BY ALL),
bad AS (SELECT mix_id FROM w LEFT JOIN voices v USING (voice_id) GROUP BY mix_id HAVING count(*) > count(v.embedding)),
x AS (SELECT mix_id, weight / sum(weight) OVER (PARTITION BY mix_id) AS w, unnest(embedding) AS e, unnest(range(64)) AS dim FROM w JOIN voices USING (voice_id) WHERE mix_id NOT IN (FROM bad))
SELECT mix_id, CAST(dim AS INTEGER) AS dim, round(sum(e * w), 6) AS value, CAST(NULL AS VARCHAR) AS error FROM x GROUP BY mix_id, dim UNION ALL SELECT mix_id, NULL, NULL, 'unknown voice or no weight' FROM bad""",
    "filter_voices": f"{_B} SELECT voice_id, ['a', 'b', 'e', 'f', 'j'][voice_id % 5 + 1] || 'f_' || voice_id AS voice_name FROM voices WHERE label % 2 = 0 AND voice_id % 5 < 2",
    "centroids": f"{_B}, m AS (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS dim, unnest(embedding) AS x FROM vecs) GROUP BY ALL) SELECT label, CAST(dim AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m",
    "set_similarity": f"{_B}, y AS (SELECT label, vec_id, unnest(range(64)) AS dim, unnest(embedding) AS x FROM vecs), m AS (SELECT label, dim, avg(x) AS a, avg(x + CASE WHEN (vec_id + dim) % 3 = 0 THEN 0.3::DOUBLE ELSE -0.1::DOUBLE END) AS b FROM y GROUP BY ALL) SELECT label, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS sim FROM m GROUP BY label",
    "multi_hot": "SELECT user_id AS rec, CASE WHEN count(DISTINCT event_id % 600) FILTER (event_id % 600 < 527) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS total, coalesce(round(1.0::DOUBLE / nullif(count(DISTINCT event_id % 600) FILTER (event_id % 600 < 527), 0), 9), 0) AS each FROM events GROUP BY user_id",
    "active_classes": "SELECT user_id AS rec, coalesce(string_agg(DISTINCT CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (c < 527), '') AS classes FROM (SELECT DISTINCT user_id, event_id % 600 AS c FROM events) GROUP BY user_id".replace("DISTINCT CAST", "CAST"),
    "class_indices": "SELECT upper(event_type) AS name, CAST(min(event_id % 527) AS INTEGER) AS idx, CAST(NULL AS VARCHAR) AS error FROM events GROUP BY event_type UNION ALL SELECT 'Nothing', NULL, 'unknown class Nothing'",
    "group_scores": "WITH g AS (SELECT vec_id % 527 AS c, min(label) % 7 AS grp FROM embeddings GROUP BY 1) SELECT user_id AS rec, grp, max(value / 500) AS score FROM events JOIN g ON event_id % 527 = c GROUP BY ALL",
}
