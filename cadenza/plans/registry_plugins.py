"""Checked queries for recommenders and metrics given as functions (E17, E18), the
results log's commits (S4) and the model store (S5).

Popularity lists follow from the tables alone, so their oracles hold every
value: the lists, E1 to E16 over them and the metrics added here.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from cadenza.operators import results as R
from cadenza.plans import contract as CT
from cadenza.plans import evaluate as EV
from cadenza.plans import registry as G
from cadenza.plans.registry import K, register, rounded
from cadenza.plans.registry_models import _TRAIN, _split
from cadenza.session import scratch_path
from cadenza.sources.fixtures import view

_EXTRA = (CT.mean_reciprocal_rank, CT.mean_average_precision)


def _popular_sql(value: str) -> str:
    """CTEs of the lists by popularity, under the names that the metric oracles read."""
    return f"""
places AS MATERIALIZED (SELECT artist, row_number() OVER (ORDER BY {value} DESC, artist) AS place, {value} AS popularity
        FROM train WHERE artist IS NOT NULL GROUP BY artist),
lists AS MATERIALIZED (SELECT user_id, artist, popularity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT w.user_id, p.artist, p.popularity, row_number() OVER (PARTITION BY w.user_id ORDER BY p.place) AS rank
  FROM (SELECT DISTINCT user_id FROM relevant) w CROSS JOIN places p
  WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = w.user_id AND t.artist = p.artist)) WHERE rank <= {K}),
recs_fx AS (SELECT user_id, rank, artist AS item_id FROM lists),
relevant_fx AS (SELECT user_id, artist AS item_id FROM relevant),
genre_fx AS (SELECT artist AS item_id, min(genre) AS genre FROM train GROUP BY artist),
seen AS (SELECT user_id, artist AS item_id, play_count FROM train),
item_vecs AS (SELECT item_id, CAST([] AS DOUBLE[]) AS embedding FROM seen WHERE false),"""


_FIRST = f"""
firsts AS (SELECT v.user_id, min(r.rank) AS first FROM relevant_fx v
  LEFT JOIN recs_fx r ON r.user_id = v.user_id AND r.item_id = v.item_id AND r.rank <= {K} GROUP BY v.user_id),
gains AS (SELECT user_id, sum(CAST(nth AS DOUBLE) / rank) AS gain FROM (
    SELECT r.user_id, r.rank, row_number() OVER (PARTITION BY r.user_id ORDER BY r.rank) AS nth
    FROM recs_fx r JOIN relevant_fx v ON v.user_id = r.user_id AND v.item_id = r.item_id WHERE r.rank <= {K})
  GROUP BY user_id)"""
_EXTRA_SELECT = f"""
(SELECT round(avg(coalesce(1.0 / first, 0.0)), 6) FROM firsts) AS mrr_at_{K},
(SELECT round(avg(coalesce(g.gain / least({K}, rel.n_rel), 0.0)), 6) FROM rel LEFT JOIN gains g USING (user_id)) AS map_at_{K}"""
_ACCURACY_SELECT = f"""round((SELECT avg(p) FROM per), 6) AS precision_at_5, round((SELECT avg(r) FROM per), 6) AS recall_at_5,
       round((SELECT avg(g) FROM per), 6) AS ndcg_at_5, round((SELECT avg(h) FROM per), 6) AS hit_rate_at_5,
       round({G._COVERAGE.strip()}, 6) AS coverage"""


@register("popular_lists", f"""{_TRAIN}, {_popular_sql("sum(play_count)").rsplit("recs_fx AS", 1)[0].strip().rstrip(",")}
SELECT user_id, rank, artist, CAST(popularity AS DOUBLE) AS score FROM lists""")
def q_popular_lists(spark, d):
    data, popular = _split(spark, d), EV.RECOMMENDERS["popularity"]
    learned = popular.train(data.train, {}, CT.Columns())
    return popular.lists(learned, data.relevant.select("user_id"), K, {}).select("user_id", "rank", "artist", "score")


@register("evaluate_popularity", f"""{_TRAIN}, {_popular_sql("count(DISTINCT user_id)").strip()}
{G._PER_USER.strip()}, {G._SER_CTES}, {_FIRST.strip()}
SELECT {_ACCURACY_SELECT}, {_EXTRA_SELECT.strip()}, * FROM ({G._SER_SELECT.strip()})""")
def q_evaluate_popularity(spark, d):
    """E17 with a recommender and two metrics given as functions."""
    config = EV.ModelConfig("listeners", replace(CT.popularity("listeners"), name="by listeners"))
    out = EV.evaluate_model(config, _split(spark, d), K, include_serendipity=True, metrics=_EXTRA)
    return rounded(out, *out.columns)


def _sweep_one(name: str, value: str) -> str:
    return f"""(WITH {_popular_sql(value).strip()}
{G._PER_USER.strip()}, {_FIRST.strip()}
SELECT '{name}' AS model_name, 'ok' AS status, {_ACCURACY_SELECT}, {_EXTRA_SELECT.strip()})"""


_NONE = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("precision_at_5", "recall_at_5", "ndcg_at_5", "hit_rate_at_5",
                                                           "coverage", f"mrr_at_{K}", f"map_at_{K}"))


@register("compare_plugins", f"""{_TRAIN}
SELECT *, CAST(2 AS BIGINT) AS trained_again FROM (
SELECT * FROM {_sweep_one("plays", "sum(play_count)")}
UNION ALL BY NAME SELECT * FROM {_sweep_one("listeners", "count(DISTINCT user_id)")}
UNION ALL BY NAME SELECT 'lost job' AS model_name, 'failed' AS status, {_NONE}
UNION ALL BY NAME SELECT 'bad lists' AS model_name, 'failed' AS status, {_NONE})""")
def q_compare_plugins(spark, d):
    """Two configs that work, one whose Spark job fails, one whose lists are
    malformed; then the same sweep again, which takes the committed results and
    trains for the failed ones only."""
    trained = []

    def counted(r: CT.Recommender) -> CT.Recommender:
        def train(rows, params, c):
            trained.append(r.name)
            return r.train(rows, params, c)
        return replace(r, train=train)

    def lost(rows, params, c):
        rows.select(F.raise_error(F.lit("a task fails"))).write.format("noop").mode("overwrite").save()

    def twice(learned, users, k, params):
        one = CT.popularity().lists(learned, users, k, params)
        return one.unionByName(one)

    plays, listeners = CT.popularity(), replace(CT.popularity("listeners"), name="by listeners")
    configs = [EV.ModelConfig("plays", counted(plays)), EV.ModelConfig("listeners", counted(listeners)),
               EV.ModelConfig("lost job", counted(replace(plays, name="lost", train=lost))),
               EV.ModelConfig("bad lists", counted(replace(plays, name="twice", lists=twice)))]
    df = view(spark, d, "interactions")
    at = scratch_path(spark, "sweep")
    EV.compare_models(configs, df, metrics=_EXTRA, sweep_path=at)
    trained.clear()
    out = EV.compare_models(configs, df, metrics=_EXTRA, sweep_path=at)
    numbers = [c for c in out.columns if c not in ("model_name", "kind", "param", "status")]
    return rounded(out, *numbers).select("model_name", F.split("status", ":")[0].alias("status"), *numbers,
                                         F.lit(len(trained)).cast("long").alias("trained_again"))


@register("save_results", """
SELECT data_name, model_name, execute_date, param, arg_max(metrics, seq) AS metrics, 10 AS versions, count(*) AS n_rows
FROM results_fx GROUP BY data_name, model_name, execute_date, param""", ("results_fx",))
def q_save_results(spark, d):
    """Every data set's rows are committed by a writer of their own, all at
    the same time and each in two commits; the log is then read back and
    upserted."""
    log = view(spark, d, "results_fx")
    path = scratch_path(spark, "log")
    sets = [r.data_name for r in log.select("data_name").distinct().collect()]  # a handful of names
    half = log.agg(F.percentile_approx("seq", 0.5)).first()[0]

    def write(name):
        mine = log.where(F.col("data_name") == name)
        for part in (mine.where(F.col("seq") <= half), mine.where(F.col("seq") > half)):
            R.append_results(part, path, "seq")

    with ThreadPoolExecutor(len(sets)) as pool:
        for job in [pool.submit(inheritable_thread_target(spark)(write), name) for name in sets]:
            job.result()
    counts = R.read_results(spark, path).groupBy(*R.KEY, "param").agg(F.count(F.lit(1)).alias("n_rows"))
    return R.current_results(spark, path).join(counts, [*R.KEY, "param"]).select(
        *R.KEY, "param", "metrics", F.lit(len(R.versions(spark, path))).cast("int").alias("versions"), "n_rows")
