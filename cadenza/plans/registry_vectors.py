"""Checked queries for scoring, ranking, reranking, neighbours and reasons
on the fixed fixture vectors (independent of ALS training).

The oracles are brute force (every user × item pair in DuckDB); the Spark
side runs the blocked top-k, so each check compares the blocked plan with
the definition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.columns import cosine
from cadenza.operators import lsh as L
from cadenza.operators import pruned as PR
from cadenza.operators import reasons as RS
from cadenza.operators import recommend as RC
from cadenza.operators import vectors as V
from cadenza.plans.registry import ORACLE, register, rounded
from cadenza.sources.fixtures import table, view, with_views

_VIEWS = ["user_vecs", "item_vecs", "seen"]


def _v(spark, d):
    return view(spark, d, "user_vecs"), view(spark, d, "item_vecs"), view(spark, d, "seen")


def _prefix(names):
    return with_views("SELECT 1", list(names)).rsplit("\nSELECT 1", 1)[0]


_TOPN = """
scored AS (SELECT u.user_id, i.item_id, list_dot_product(u.embedding, i.embedding) AS score
           FROM user_vecs u CROSS JOIN item_vecs i
           WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = i.item_id)),
ranked AS MATERIALIZED (SELECT user_id, item_id, score,
                  CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank
           FROM scored)"""


@register("score_pairs", """
SELECT s.user_id, s.item_id, round(list_dot_product(u.embedding, i.embedding), 6) AS score
FROM seen s JOIN user_vecs u ON u.user_id = s.user_id JOIN item_vecs i ON i.item_id = s.item_id""",
          tuple(_VIEWS))
def q_score_pairs(spark, d):
    u, i, s = _v(spark, d)
    pairs = (s.select("user_id", "item_id")
              .join(u.select("user_id", F.col("embedding").alias("uv")), "user_id")
              .join(i.select("item_id", F.col("embedding").alias("iv")), "item_id"))
    return rounded(V.score_pairs(pairs, "uv", "iv").select("user_id", "item_id", "score"), "score")


@register("cosine_pairs", """
SELECT s.user_id, s.item_id, round(list_cosine_similarity(u.embedding, i.embedding), 6) AS similarity
FROM seen s JOIN user_vecs u ON u.user_id = s.user_id JOIN item_vecs i ON i.item_id = s.item_id""",
          tuple(_VIEWS))
def q_cosine_pairs(spark, d):
    u, i, s = _v(spark, d)
    pairs = (s.select("user_id", "item_id")
              .join(u.select("user_id", F.col("embedding").alias("uv")), "user_id")
              .join(i.select("item_id", F.col("embedding").alias("iv")), "item_id"))
    return rounded(V.cosine_pairs(pairs, "uv", "iv").select("user_id", "item_id", "similarity"),
                   "similarity")


@register("unseen_candidates", """
SELECT r.user_id, r.rank, r.item_id FROM recs_fx r
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = r.user_id AND s.item_id = r.item_id)""",
          ("recs_fx", "seen"))
def q_unseen(spark, d):
    return RC.exclude_seen(view(spark, d, "recs_fx"), view(spark, d, "seen"))


@register("topn_unseen", ", " + _TOPN.strip() + """
SELECT user_id, rank, item_id, round(score, 6) AS score FROM ranked WHERE rank <= 10""")
def q_topn(spark, d):
    u, i, s = _v(spark, d)
    return rounded(RC.top_n_unseen(u, i, s, 10), "score")


@register("candidate_pool", ", " + _TOPN.strip() + """
SELECT user_id, rank, item_id, round(score, 6) AS score FROM ranked WHERE rank <= 20""")
def q_pool(spark, d):
    u, i, s = _v(spark, d)
    return rounded(RC.candidate_pool(u, i, s, 20), "score")


_SIM = """
sim AS (SELECT a.{id} AS left_id, b.{id} AS right_id, list_cosine_similarity(a.embedding, b.embedding) AS s
        FROM {t} a JOIN {t} b ON a.{id} <> b.{id}),
nbr AS (SELECT left_id, right_id, s,
               CAST(row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id) AS INTEGER) AS rank
        FROM sim)"""


@register("similar_items", ", " + _SIM.format(id="item_id", t="item_vecs").strip() + """
SELECT left_id AS item_id, right_id AS similar_item, round(s, 6) AS similarity, rank FROM nbr WHERE rank <= 10""")
def q_similar_items(spark, d):
    _, i, _ = _v(spark, d)
    out = V.similar(i, 10, id_col="item_id", vec="embedding")
    return rounded(out.select(F.col("left_id").alias("item_id"), F.col("right_id").alias("similar_item"),
                              "similarity", F.col("rank").cast("int").alias("rank")), "similarity")


@register("similar_users", ", " + _SIM.format(id="user_id", t="user_vecs").strip() + """
SELECT left_id AS user_id, right_id AS similar_user, round(s, 6) AS similarity, rank FROM nbr WHERE rank <= 10""")
def q_similar_users(spark, d):
    u, _, _ = _v(spark, d)
    return rounded(RC.similar_users(u, 10), "similarity")


def _mmr_sql(lam: float, n: int, pool: int, as_cte: str | None = None) -> str:
    """Greedy MMR unrolled: one CTE per step (fixed n); ``as_cte`` names the
    final union as one more CTE instead of ending with it."""
    mu = 1.0 - lam
    parts = [f"pv AS MATERIALIZED (SELECT r.user_id, r.item_id, r.rank, r.score, iv.embedding AS v FROM ranked r "
             f"JOIN item_vecs iv ON iv.item_id = r.item_id WHERE r.rank <= {pool})"]
    for step in range(1, n + 1):
        joins = " ".join(f"JOIN s{j} a{j} ON a{j}.user_id = p.user_id" for j in range(1, step))
        notin = " AND ".join(f"p.item_id <> a{j}.item_id" for j in range(1, step)) or "TRUE"
        sims = ", ".join(f"list_cosine_similarity(p.v, a{j}.v)" for j in range(1, step))
        maxsim = f"greatest(0.0, {sims})" if sims else "0.0"
        parts.append(
            f"s{step} AS MATERIALIZED (SELECT user_id, item_id, rank, score, v FROM ("
            f"SELECT p.*, row_number() OVER (PARTITION BY p.user_id ORDER BY "
            f"{lam!r} * p.score - {mu!r} * {maxsim} DESC, p.rank) AS rn "
            f"FROM pv p {joins} WHERE {notin}) WHERE rn = 1)")
    sel = " UNION ALL ".join(
        f"SELECT user_id, CAST({s} AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM s{s}"
        for s in range(1, n + 1))
    if as_cte:
        return ",\n".join(parts + [f"{as_cte} AS ({sel})"])
    return ",\n".join(parts) + "\n" + sel


@register("mmr_rerank", ", " + _TOPN.strip() + ",\n" + _mmr_sql(0.3, 3, 20))
def q_mmr_rerank(spark, d):
    u, i, s = _v(spark, d)
    pool = RC.candidate_pool(u, i, s, 20)
    return rounded(RC.mmr_rerank(pool, i, 0.3, 3), "score")


@register("mmr_recommend", ", " + _TOPN.strip() + ",\n" + _mmr_sql(0.5, 3, 20))
def q_mmr_recommend(spark, d):
    u, i, s = _v(spark, d)
    return rounded(RC.mmr_recommend(u, i, s, 3, lambda_param=0.5, candidate_pool_size=20), "score")


@register("compare_methods", ", " + _TOPN.strip() + ",\n" + _mmr_sql(0.5, 3, 20, "m") + """
SELECT user_id, rank, item_id, round(score, 6) AS score, 'standard' AS method FROM ranked WHERE rank <= 3
UNION ALL SELECT user_id, rank, item_id, score, 'mmr' AS method FROM m""")
def q_compare(spark, d):
    u, i, s = _v(spark, d)
    return rounded(RC.compare_methods(u, i, s, 3, lambda_param=0.5, candidate_pool_size=20), "score")


@register("userbased_recommend", ", " + _SIM.format(id="user_id", t="user_vecs").strip() + """,
t AS (SELECT user_id, item_id, sum(play_count) AS plays FROM seen GROUP BY user_id, item_id),
cand AS (SELECT n.left_id AS user_id, t.item_id, sum(n.s * t.plays) AS score
         FROM nbr n JOIN t ON t.user_id = n.right_id
         WHERE n.rank <= 10
           AND NOT EXISTS (SELECT 1 FROM t x WHERE x.user_id = n.left_id AND x.item_id = t.item_id)
         GROUP BY n.left_id, t.item_id)
SELECT user_id, rank, item_id, round(score, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank
  FROM cand) WHERE rank <= 5""")
def q_userbased(spark, d):
    u, _, s = _v(spark, d)
    return rounded(RC.user_based_recommend(s, u, 5, 10), "score")


@register("item_reasons", ", " + _TOPN.strip() + """,
recs AS (SELECT user_id, item_id, rank FROM ranked WHERE rank <= 5),
ls AS (SELECT DISTINCT user_id, item_id AS reason_item FROM seen),
pr AS (SELECT r.user_id, r.item_id, l.reason_item, list_cosine_similarity(a.embedding, b.embedding) AS sim
       FROM recs r JOIN ls l ON l.user_id = r.user_id
       JOIN item_vecs a ON a.item_id = r.item_id JOIN item_vecs b ON b.item_id = l.reason_item),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, reason_item) AS rn
                        FROM pr WHERE sim > 0) WHERE rn = 1)
SELECT r.user_id, r.rank, r.item_id, b.reason_item, round(b.sim, 6) AS similarity,
       CASE WHEN b.reason_item IS NULL THEN 'popularity' ELSE 'similar_item' END AS reason
FROM recs r LEFT JOIN best b ON b.user_id = r.user_id AND b.item_id = r.item_id""")
def q_item_reasons(spark, d):
    u, i, s = _v(spark, d)
    recs = RC.top_n_unseen(u, i, s, 5)
    return rounded(RS.item_reasons(recs, s, i), "similarity")


@register("user_reasons", ", " + _SIM.format(id="user_id", t="user_vecs").strip() + """,
top1 AS (SELECT left_id AS user_id, right_id AS nb, s FROM nbr WHERE rank = 1),
t AS (SELECT user_id, item_id, CAST(sum(play_count) AS BIGINT) AS plays FROM seen GROUP BY user_id, item_id),
sh AS (SELECT * FROM (
         SELECT p.user_id, p.nb, a.item_id, a.plays AS p1, b.plays AS p2,
                row_number() OVER (PARTITION BY p.user_id, p.nb ORDER BY a.plays + b.plays DESC, a.item_id) AS rk
         FROM top1 p JOIN t a ON a.user_id = p.user_id JOIN t b ON b.user_id = p.nb AND b.item_id = a.item_id)
       WHERE rk <= 3)
SELECT p.user_id, p.nb AS similar_user, round(p.s, 6) AS similarity, CAST(sh.rk AS INTEGER) AS rank,
       sh.item_id, sh.p1 AS plays_user, sh.p2 AS plays_similar
FROM top1 p LEFT JOIN sh ON sh.user_id = p.user_id AND sh.nb = p.nb""")
def q_user_reasons(spark, d):
    u, _, s = _v(spark, d)
    return rounded(RS.user_reasons(s, u, top_n=3), "similarity")


# lists hold scores of 0.4 to 0.99, neighbours similarities of at least 0.35; users beyond
# the embeddings are unknown: all four statuses occur at every scale factor
_WANTED = "wanted AS (SELECT DISTINCT (31 * event_id + user_id) % (SELECT CAST(1.2 * count(*) AS BIGINT) FROM embeddings) AS user_id FROM events)"


@register("recommend_status", ", " + _TOPN.strip() + f",\n{_WANTED},\n" + _SIM.format(id="user_id", t="user_vecs").strip() + """
SELECT w.user_id,
       CASE WHEN w.user_id NOT IN (SELECT user_id FROM user_vecs) THEN 'unknown_user'
            WHEN w.user_id NOT IN (SELECT left_id FROM nbr WHERE rank = 1 AND s >= 0.35) THEN 'no_neighbours'
            WHEN coalesce(r.n, 0) = 0 THEN 'no_candidates' ELSE 'ok' END AS status,
       coalesce(r.n, 0) AS n_recs
FROM wanted w LEFT JOIN (SELECT user_id, count(*) AS n FROM ranked WHERE rank <= 5 AND score BETWEEN 0.4 AND 0.99 GROUP BY user_id) r
  ON r.user_id = w.user_id""")
def q_status(spark, d):
    u, i, s = _v(spark, d)
    n = u.agg((F.lit(1.2) * F.count(F.lit(1))).cast("long")).scalar()
    wanted = table(spark, d, "events").select(((31 * F.col("event_id") + F.col("user_id")) % n).alias("user_id")).distinct()
    recs = RC.top_n_unseen(u, i, s, 5, users=wanted).where("score BETWEEN 0.4 AND 0.99")
    near = RC.similar_users(u, 1, users=wanted).where("similarity >= 0.35")
    return RC.recommend_status(wanted, u, recs, near)


def _top_axis(cov: str, name: str, squarings: int = 13) -> str:
    """CTEs of the first eigenvector (``<name>_v``) of the symmetric matrix
    ``cov(i, r)``, its rows being lists: the matrix is squared over and over, scaled
    by its trace, until only the first axis is left in its rows."""
    steps, prev = [], cov
    for k in range(squarings):
        steps.append(f"""{name}_{k} AS MATERIALIZED (
SELECT i, list_transform(r, lambda x: x / t) AS r FROM (
  SELECT a.i, list(list_dot_product(a.r, b.r) ORDER BY b.i) AS r, (SELECT sum(list_dot_product(r, r)) FROM {prev}) AS t
  FROM {prev} a CROSS JOIN {prev} b GROUP BY a.i))""")
        prev = f"{name}_{k}"
    steps.append(f"""{name}_v AS MATERIALIZED (
SELECT list_transform(r, lambda x: x / n) AS v FROM (
  SELECT r, sqrt(list_dot_product(r, r)) AS n FROM {prev} ORDER BY r[i] DESC, i LIMIT 1))""")
    return ",\n".join(steps)


# the sign of an axis is free, so both sides return absolute coordinates
@register("project_2d", """,
dims AS (SELECT i, list(x ORDER BY item_id) AS r, avg(x) AS m
         FROM (SELECT item_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM item_vecs) GROUP BY i),
centred AS MATERIALIZED (SELECT i, list_transform(r, lambda x: x - m) AS r FROM dims),
cov AS MATERIALIZED (SELECT a.i, list(list_dot_product(a.r, b.r) ORDER BY b.i) AS r
                     FROM centred a CROSS JOIN centred b GROUP BY a.i),
""" + _top_axis("cov", "first") + """,
size1 AS MATERIALIZED (SELECT sum(first_v.v[cov.i] * list_dot_product(cov.r, first_v.v)) AS l FROM cov CROSS JOIN first_v),
rest AS MATERIALIZED (
  SELECT i, list(x - l * v[i] * v[j] ORDER BY j) AS r
  FROM (SELECT i, unnest(r) AS x, generate_subscripts(r, 1) AS j FROM cov) CROSS JOIN first_v CROSS JOIN size1 GROUP BY i),
""" + _top_axis("rest", "second") + """
SELECT item_id, genre, round(abs(list_dot_product(embedding, a.v)), 6) AS x,
       round(abs(list_dot_product(embedding, b.v)), 6) AS y
FROM item_vecs CROSS JOIN first_v a CROSS JOIN second_v b""")
def q_project(spark, d):
    _, i, _ = _v(spark, d)
    xy = V.project_2d(i, id_col="item_id", vec="embedding")
    out = xy.join(i.select("item_id", "genre"), "item_id", "left")
    return rounded(out.select("item_id", "genre", F.abs("x").alias("x"), F.abs("y").alias("y")), "x", "y")


# items weighted by their plays: long vectors for what is played most, as trained factors have
_WEIGHTED = """
w AS (SELECT v.item_id, v.embedding, CAST(coalesce(p.plays, 0) AS DOUBLE) * coalesce(p.plays, 0) AS w
      FROM item_vecs v LEFT JOIN (SELECT item_id, sum(play_count) AS plays FROM seen GROUP BY item_id) p ON p.item_id = v.item_id),
scored AS MATERIALIZED (SELECT u.user_id, i.item_id, i.w * list_dot_product(u.embedding, i.embedding) AS score,
                  sqrt(list_dot_product(u.embedding, u.embedding)) AS ul, i.w * sqrt(list_dot_product(i.embedding, i.embedding)) AS il
           FROM user_vecs u CROSS JOIN w i)"""
_UNSEEN = "NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = c.user_id AND s.item_id = c.item_id)"
_PRUNE_BLOCK = 64


def _weighted_items(i, s):
    plays = s.groupBy("item_id").agg(F.sum("play_count").cast("double").alias("plays"))
    weight = F.coalesce("plays", F.lit(0.0)) * F.coalesce("plays", F.lit(0.0))
    return i.select("item_id", "embedding").join(plays, "item_id", "left").select(
        "item_id", F.transform("embedding", lambda x: x * weight).alias("embedding"))


@register("topn_pruned", ", " + _WEIGHTED.strip() + f"""
SELECT user_id, rank, item_id, round(score, 6) AS score FROM (
  SELECT c.*, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank
  FROM scored c WHERE {_UNSEEN}) WHERE rank <= 10""")
def q_topn_pruned(spark, d):
    """M4 by the pruned plan."""
    u, i, s = _v(spark, d)
    return rounded(RC.top_n_unseen(u, _weighted_items(i, s), s, 10, pruned=True), "score")


@register("pruned_blocks", ", " + _WEIGHTED.strip() + f""",
placed AS (SELECT item_id, (row_number() OVER (ORDER BY il DESC, item_id) - 1) // {_PRUNE_BLOCK} AS block, il
           FROM (SELECT DISTINCT item_id, il FROM scored)),
longest AS (SELECT block, max(il) AS il FROM placed GROUP BY block),
best AS (SELECT c.user_id, l.block, max(c.score, 10) AS best FROM scored c JOIN placed p USING (item_id)
         JOIN longest l ON p.block < l.block WHERE {_UNSEEN} GROUP BY c.user_id, l.block),
met AS (SELECT u.user_id, l.block, l.block = 0 OR coalesce(len(b.best), 0) < 10 OR b.best[10] <= u.ul * l.il * (1 + 1e-9) AS met
        FROM (SELECT DISTINCT user_id, ul FROM scored) u CROSS JOIN longest l LEFT JOIN best b USING (user_id, block))
SELECT user_id, CAST(sum(met::INT) AS BIGINT) AS blocks_met, count(*) AS blocks, false AS went_on FROM met GROUP BY user_id""")
def q_pruned_blocks(spark, d):
    """How much of the right side each user met: what is left was skipped."""
    u, i, s = _v(spark, d)
    return PR.topk_pruned(u, _weighted_items(i, s), 10, left_id="user_id", right_id="item_id", exclude=s,
                          exclude_left="user_id", exclude_right="item_id", block_rows=_PRUNE_BLOCK).work.withColumnRenamed(
        "left_id", "user_id")


@register("similar_users_lsh", """
SELECT count(*) AS n_users, 10 * count(*) AS links, TRUE AS recall_reached, TRUE AS exact FROM user_vecs""", ("user_vecs",))
def q_similar_users_lsh(spark, d):
    """M11 by signatures, measured against the exact neighbours: nine in ten or
    more of these are found, and each similarity is the exact one."""
    u, _, _ = _v(spark, d)
    found = L.similar_lsh(u, 10, id_col="user_id", copy_cost=16.0).checkpoint(eager=True)
    exact = V.similar(u, 10, id_col="user_id")
    got = L.recall(found, exact)
    vec = u.select("user_id", "embedding")
    true = (found.join(vec.select(F.col("user_id").alias("left_id"), F.col("embedding").alias("a")), "left_id")
            .join(vec.select(F.col("user_id").alias("right_id"), F.col("embedding").alias("b")), "right_id"))
    same = F.min(F.abs(cosine("a", "b") - F.col("similarity")) < 1e-9)
    sums = true.agg(F.countDistinct("left_id").alias("n_users"), same.alias("exact"))
    return sums.crossJoin(got).select("n_users", "links", (F.col("recall") >= 0.9).alias("recall_reached"), "exact")


for _n in ("topn_unseen", "topn_pruned", "pruned_blocks", "candidate_pool", "mmr_rerank", "mmr_recommend", "compare_methods",
           "item_reasons", "recommend_status"):
    ORACLE[_n] = _prefix(_VIEWS) + ORACLE[_n]
for _n in ("similar_items", "project_2d"):
    ORACLE[_n] = _prefix(["item_vecs"]) + ORACLE[_n]
for _n in ("similar_users", "userbased_recommend", "user_reasons"):
    ORACLE[_n] = _prefix(["user_vecs", "seen"]) + ORACLE[_n]
