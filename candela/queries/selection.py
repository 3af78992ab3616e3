"""Batch selection, Pareto fronts, surrogate acquisition and conformal intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions import sequence as S
from candela.operators import conformal
from candela.operators.selection import dpp, novelty, pareto, surrogate
from candela.operators.staging import spread
from candela.queries.tables import SEQ_HASH, hashed, seq_hash, table
from candela.queries import sequences as Q

GAMMA = 1.0 / 64


def novelty_batch(spark, sf_dir):
    d = seq_hash(spark, sf_dir).select(F.col("doc_id").alias("candidate_id"), "sequence")
    return novelty.select_batch(d, 3).select("candidate_id", "rank", "selected", F.col("selection_step").cast("int").alias("selection_step"), "priority_score", "exploration_score")


def kmer_jaccard_topk(spark, sf_dir):
    """The ten pairs of documents most alike by 3-mers, among all pairs."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", S.kmers(hashed(F.col("doc_id"))).alias("k"))
    return novelty.most_alike(d, 10, id_col="doc_id", kmers_col="k").select("doc_id", "other_id", F.round("similarity", 6).alias("similarity"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") * 37 % 101).cast("double").alias("quality"))


def dpp_batch(spark, sf_dir):
    t = dpp.select_batch(_vectors(spark, sf_dir), 3, order_col="vec_id", vector_col="x", quality_col="quality", temperature=10.0, gamma=GAMMA)
    return t.select("step", "vec_id", "quality", F.round("log_det", 5).alias("log_det"))


def dpp_batch_10(spark, sf_dir):
    return dpp.select_batch(_vectors(spark, sf_dir), 10, order_col="vec_id", vector_col="x", quality_col="quality", temperature=50.0, gamma=GAMMA)


def _orders(spark, sf_dir):
    """orders as points: price, day of the year and customer, all scaled."""
    o = table(spark, sf_dir, "orders")
    price, day = F.col("o_totalprice").cast("double"), F.dayofyear("o_orderdate")
    return o.select("o_orderkey", price.alias("price"), day.cast("double").alias("day"), F.array(price / 50_000, day / 60.0, (F.col("o_custkey") % 97) / 20.0).alias("x"), (price / 1000).alias("quality"))


def dpp_orders(spark, sf_dir):
    """A diverse batch of fifty among all orders."""
    return dpp.select_batch(_orders(spark, sf_dir), 50, order_col="o_orderkey", vector_col="x", quality_col="quality", temperature=50.0, gamma=1.0).select("step", "o_orderkey", F.round("quality", 4).alias("quality"), F.round("log_det", 4).alias("log_det"))


def pareto_orders(spark, sf_dir):
    """The fronts of all orders by price and day of the year."""
    return pareto.fronts(_orders(spark, sf_dir).select("o_orderkey", "price", "day"), "o_orderkey", ["price", "day"]).select("o_orderkey", "pareto_rank")


def _suppliers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("volume"), F.round(F.avg("l_discount"), 6).alias("discount"))
    return li


def pareto_front(spark, sf_dir):
    return pareto.front(_suppliers(spark, sf_dir), ["volume", "discount"]).select("l_suppkey", "volume", "discount")


def pareto_ranks(spark, sf_dir):
    return pareto.fronts(_suppliers(spark, sf_dir), "l_suppkey", ["volume", "discount"]).select("l_suppkey", "pareto_rank")


def crowding_topk(spark, sf_dir):
    t = pareto.top_k(_suppliers(spark, sf_dir), "l_suppkey", ["volume", "discount"], 12)
    inf = F.col("crowding_distance") == float("inf")
    return t.select("l_suppkey", "pareto_rank", F.when(~inf, F.round("crowding_distance", 5)).alias("crowding_distance"), inf.alias("is_end"))


def gp_acquisition(spark, sf_dir):
    """Upper confidence bounds of all vectors, one in ten of them measured."""
    v = _vectors(spark, sf_dir).select("vec_id", F.transform("x", lambda e: e / 4).alias("x"), F.col("quality").alias("y"))
    a = surrogate.acquisition(v, v.where("vec_id % 10 = 0").select("x", (F.col("y") / 100).alias("y")), kind="UCB", seed=1)
    return a.select("vec_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.round("acquisition", 6).alias("acquisition"))


def gp_two_measured(spark, sf_dir):
    """Upper confidence bounds of all vectors where two are measured: the posterior has a closed form."""
    v = _vectors(spark, sf_dir).select("vec_id", F.transform("x", lambda e: e / 4).alias("x"), F.col("quality").alias("y"))
    a = surrogate.acquisition(v, v.where("vec_id < 2").select("x", (F.col("y") / 100).alias("y")), kind="UCB", seed=1)
    return a.select("vec_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.round("acquisition", 6).alias("acquisition"))


def feature_acquisition(spark, sf_dir):
    """Upper confidence bounds from two random features, whose normal equations are summed over all measured vectors, one in ten."""
    v = _vectors(spark, sf_dir).select("vec_id", F.transform("x", lambda e: e / 4).alias("x"), F.col("quality").alias("y"))
    a = surrogate.acquisition(v, v.where("vec_id % 10 = 0").select("x", (F.col("y") / 100).alias("y")), kind="UCB", seed=3, max_rows=0, features=2)
    return a.select("vec_id", F.round("mean", 6).alias("mean"), (F.col("variance") * 1e6).alias("variance_ppm"), F.round("acquisition", 6).alias("acquisition"))


def async_batch(spark, sf_dir):
    """Expected improvement over fantasy worlds of pending candidates, then a diverse batch: in fifty candidates one is
    measured and one pending."""
    d = Q.seq_hash(spark, sf_dir).select(F.col("doc_id").alias("candidate_id"), S.feature_vector(F.col("sequence")).alias("x"), (F.col("doc_id") % 97 / 97).alias("y"))
    state = F.col("candidate_id") % 50
    return surrogate.propose(d.where(state > 1), d.where(state == 0), d.where(state == 1), batch_size=5, seed=11)


def _predicted(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 110000.0).alias("truth"), (F.col("l_quantity") * 1500.0 / 110000.0).alias("predicted"))


def conformal_interval(spark, sf_dir):
    d = _predicted(spark, sf_dir)
    m = conformal.calibrate(d, F.col("truth"), F.col("predicted"))
    cols = conformal.intervals(F.col("predicted"), m)
    out = d.select(*(F.round(v, 7).alias(k) if k != "is_high_uncertainty" else v.alias(k) for k, v in cols.items()))
    return out.groupBy("lower_bound", "upper_bound", "interval_width", "is_high_uncertainty").agg(F.count("*").alias("n"))


def conformal_coverage(spark, sf_dir):
    d = _predicted(spark, sf_dir)
    m = conformal.calibrate(d, F.col("truth"), F.col("predicted"))
    c = conformal.intervals(F.col("predicted"), m)
    return conformal.coverage(d, F.col("truth"), c["lower_bound"], c["upper_bound"]).select(F.round("coverage", 6).alias("coverage"))


_V = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(vec_id * 37 % 101 AS DOUBLE) AS s FROM embeddings)"
_K = "exp(-1.0::DOUBLE / 64 * pow(list_distance({}.x, {}.x), 2))"
_SUP = "(SELECT l_suppkey, round(sum(l_quantity), 2) AS volume, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_suppkey)"
_DOM = "o.volume >= p.volume AND o.discount >= p.discount AND (o.volume > p.volume OR o.discount > p.discount)"
_KM = "list_distinct(list_transform(range(1, length(sequence) - 1), lambda i: substr(sequence, i, 3)))"
_JAC = "len(list_intersect({0}.k, {1}.k)) / len(list_distinct(list_concat({0}.k, {1}.k)))::DOUBLE"
_BASE = f"(SELECT doc_id AS id, {_KM} AS k, s, u, p FROM (SELECT doc_id, sequence, s, {Q._UNC} AS u, least(35.0, len(f) * 7.0) AS p FROM (SELECT doc_id, sequence, {Q._FLAGS} AS f, greatest(0.0, least(100.0, {Q._SCORE})) AS s FROM {SEQ_HASH} AS t)))"
_PRI = "round(0.55::DOUBLE * b.s + 0.30::DOUBLE * {} + 0.15::DOUBLE * b.u - b.p, 3)"
_NOV = "round((1.0 - {}) * 100.0, 3)"
_ERR = "(SELECT l_extendedprice / 110000.0::DOUBLE AS t, l_quantity * 1500.0::DOUBLE / 110000.0 AS p FROM lineitem)"
_RANK = f"(SELECT list_sort(list(abs(t - p))) AS v, least(1.0, ceil((count(*) + 1) * 0.9::DOUBLE) / count(*)) * (count(*) - 1) AS k FROM {_ERR} AS e)"
_MARGIN = f"(SELECT v[floor(k)::BIGINT + 1] + (v[least(len(v), floor(k)::BIGINT + 2)] - v[floor(k)::BIGINT + 1]) * (k - floor(k)) FROM {_RANK} AS r)"

def _feature_sql(k: int, dimensions: int = 64) -> str:
    """The k-th of the two random features of feature_acquisition."""
    directions, phases = surrogate.frequencies(dimensions, 2, 3)
    return f"cos(list_dot_product(x, {[float(w) for w in directions[:, k]]}::DOUBLE[]) + {float(phases[k])!r}::DOUBLE)"


QUERIES = {f.__name__: f for f in (novelty_batch, kmer_jaccard_topk, dpp_batch, dpp_batch_10, dpp_orders, pareto_orders, pareto_front, pareto_ranks, crowding_topk, gp_acquisition, gp_two_measured, feature_acquisition, async_batch, conformal_interval, conformal_coverage)}
SQL = {
    "novelty_batch": f"""WITH b AS (SELECT * FROM {_BASE} AS q),
      s1 AS (SELECT b.*, {_PRI.format('100')} AS pri, 100.0 AS nov FROM b ORDER BY pri DESC, id LIMIT 1),
      s2 AS (SELECT b.*, {_PRI.format(_NOV.format(_JAC.format('b', 's1')))} AS pri, {_NOV.format(_JAC.format('b', 's1'))} AS nov FROM b, s1 WHERE b.id <> s1.id ORDER BY pri DESC, b.id LIMIT 1),
      s3 AS (SELECT b.*, {_PRI.format(_NOV.format('greatest(' + _JAC.format('b', 's1') + ', ' + _JAC.format('b', 's2') + ')'))} AS pri, {_NOV.format('greatest(' + _JAC.format('b', 's1') + ', ' + _JAC.format('b', 's2') + ')')} AS nov FROM b, s1, s2 WHERE b.id NOT IN (s1.id, s2.id) ORDER BY pri DESC, b.id LIMIT 1),
      m AS (SELECT b.*, {_NOV.format('greatest(' + ', '.join(_JAC.format('b', x) for x in ('s1', 's2', 's3')) + ')')} AS nov FROM b, s1, s2, s3 WHERE b.id NOT IN (s1.id, s2.id, s3.id)),
      a AS (SELECT id, TRUE AS selected, 1 AS st, pri, nov FROM s1 UNION ALL SELECT id, TRUE, 2, pri, nov FROM s2 UNION ALL SELECT id, TRUE, 3, pri, nov FROM s3 UNION ALL SELECT id, FALSE, NULL, {_PRI.format('b.nov')}, nov FROM m AS b)
      SELECT id AS candidate_id, row_number() OVER (ORDER BY selected DESC, pri DESC, id) AS rank, selected, st AS selection_step, pri::DOUBLE AS priority_score, nov::DOUBLE AS exploration_score FROM a""",
    "kmer_jaccard_topk": f"WITH d AS (SELECT doc_id, {_KM} AS k FROM {SEQ_HASH} AS t) SELECT a.doc_id, b.doc_id AS other_id, round({_JAC.format('a', 'b')}, 6) AS similarity FROM d AS a JOIN d AS b ON a.doc_id < b.doc_id ORDER BY {_JAC.format('a', 'b')} DESC, 1, 2 LIMIT 10",
    "dpp_batch": f"""WITH v AS (SELECT *, (s - max(s) OVER ()) / 10.0::DOUBLE AS g FROM {_V} AS t),
      a AS (SELECT *, 2 * g AS ld FROM v ORDER BY ld DESC, vec_id LIMIT 1),
      b AS (SELECT v.*, 2 * a.g + 2 * v.g + ln(1 - pow({_K.format('v', 'a')}, 2)) AS ld FROM v, a WHERE v.vec_id <> a.vec_id ORDER BY ld DESC, v.vec_id LIMIT 1),
      c AS (SELECT v.*, 2 * a.g + 2 * b.g + 2 * v.g + ln(1 + 2 * {_K.format('a', 'b')} * {_K.format('v', 'a')} * {_K.format('v', 'b')} - pow({_K.format('a', 'b')}, 2) - pow({_K.format('v', 'a')}, 2) - pow({_K.format('v', 'b')}, 2)) AS ld FROM v, a, b WHERE v.vec_id NOT IN (a.vec_id, b.vec_id) ORDER BY ld DESC, v.vec_id LIMIT 1)
      SELECT 1 AS step, vec_id, s AS quality, round(ld, 5) AS log_det FROM a UNION ALL SELECT 2, vec_id, s, round(ld, 5) FROM b UNION ALL SELECT 3, vec_id, s, round(ld, 5) FROM c""",
    "pareto_front": f"SELECT * FROM {_SUP} AS p WHERE NOT EXISTS (SELECT 1 FROM {_SUP} AS o WHERE {_DOM})",
    "pareto_ranks": f"""WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {_SUP} AS t), e AS MATERIALIZED (SELECT o.l_suppkey AS a, p.l_suppkey AS b FROM s AS o JOIN s AS p ON {_DOM}),
      r AS (SELECT l_suppkey AS id, 1 AS k FROM s UNION SELECT e.b, r.k + 1 FROM r JOIN e ON e.a = r.id) SELECT id AS l_suppkey, max(k)::INT AS pareto_rank FROM r GROUP BY id""",
    "crowding_topk": f"""WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {_SUP} AS t), e AS MATERIALIZED (SELECT o.l_suppkey AS a, p.l_suppkey AS b FROM s AS o JOIN s AS p ON {_DOM}),
      r AS (SELECT l_suppkey AS id, 1 AS k FROM s UNION SELECT e.b, r.k + 1 FROM r JOIN e ON e.a = r.id WHERE r.k < 40), f AS (SELECT s.*, k FROM s JOIN (SELECT id, max(k)::INT AS k FROM r GROUP BY id) ON id = l_suppkey),
      g AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, lead(volume) OVER v AS nv, lag(volume) OVER v AS pv, lead(discount) OVER d AS nd, lag(discount) OVER d AS pd, max(volume) OVER (PARTITION BY k) - min(volume) OVER (PARTITION BY k) AS sv, max(discount) OVER (PARTITION BY k) - min(discount) OVER (PARTITION BY k) AS sd
        FROM f WINDOW v AS (PARTITION BY k ORDER BY volume, l_suppkey), d AS (PARTITION BY k ORDER BY discount, volume, l_suppkey)),
      h AS (SELECT l_suppkey, k, n <= 2 OR nv IS NULL OR pv IS NULL OR nd IS NULL OR pd IS NULL AS is_end, coalesce((nv - pv) / nullif(sv, 0), 0) + coalesce((nd - pd) / nullif(sd, 0), 0) AS c FROM g)
      SELECT l_suppkey, k AS pareto_rank, CASE WHEN NOT is_end THEN round(c, 5) END AS crowding_distance, is_end FROM h ORDER BY k, is_end DESC, c DESC, l_suppkey LIMIT 12""",
    "gp_two_measured": f"""WITH v AS (SELECT vec_id, list_transform(x, lambda e: e / 4) AS x, s / 100 AS y FROM {_V} AS t), a AS (SELECT * FROM v WHERE vec_id = 0), b AS (SELECT * FROM v WHERE vec_id = 1),
      k AS (SELECT v.vec_id, exp(-0.5::DOUBLE * pow(list_distance(v.x, a.x), 2)) AS p, exp(-0.5::DOUBLE * pow(list_distance(v.x, b.x), 2)) AS q, exp(-0.5::DOUBLE * pow(list_distance(a.x, b.x), 2)) AS c, 1 + 1e-4::DOUBLE + 1e-6::DOUBLE AS d, a.y AS ya, b.y AS yb FROM v, a, b),
      m AS (SELECT vec_id, (p * (d * ya - c * yb) + q * (d * yb - c * ya)) / (d * d - c * c) AS mean, greatest(1e-10, 1 - (d * p * p - 2 * c * p * q + d * q * q) / (d * d - c * c)) AS var FROM k)
      SELECT vec_id, round(mean, 6) AS mean, round(var, 6) AS variance, round(mean + 2 * sqrt(var), 6) AS acquisition FROM m""",
    "feature_acquisition": f"""WITH v AS (SELECT vec_id, list_transform(x, lambda e: e / 4) AS x, s / 100 AS y FROM {_V} AS t), f AS (SELECT vec_id, y, {_feature_sql(0)} AS p, {_feature_sql(1)} AS q FROM v),
      n AS (SELECT sum(p * p) + 1.01e-4::DOUBLE AS a, sum(p * q) AS b, sum(q * q) + 1.01e-4::DOUBLE AS c, sum(p * y) AS u, sum(q * y) AS w FROM f WHERE vec_id % 10 = 0),
      m AS (SELECT vec_id, (p * (c * u - b * w) + q * (a * w - b * u)) / (a * c - b * b) AS mean, greatest(1e-10, 1.01e-4::DOUBLE * (c * p * p - 2 * b * p * q + a * q * q) / (a * c - b * b)) AS var FROM f, n)
      SELECT vec_id, round(mean, 6) AS mean, var * 1e6 AS variance_ppm, round(mean + 2 * sqrt(var), 6) AS acquisition FROM m""",
    "conformal_interval": f"SELECT round(lo, 7) AS lower_bound, round(hi, 7) AS upper_bound, round(hi - lo, 7) AS interval_width, 2 * m > 0.35 AS is_high_uncertainty, count(*) AS n FROM (SELECT m, greatest(0.0, p - m) AS lo, least(1.0, p + m) AS hi FROM {_ERR} AS e, (SELECT {_MARGIN} AS m)) GROUP BY 1, 2, 3, 4",
    "conformal_coverage": f"SELECT round(avg((t BETWEEN greatest(0.0, p - m) AND least(1.0, p + m))::INT), 6) AS coverage FROM {_ERR} AS e, (SELECT {_MARGIN} AS m)",
}
