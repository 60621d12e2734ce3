"""Checked queries: each operator as a Spark query over the test tables,
paired with equivalent DuckDB SQL where the semantics are SQL-expressible.

Every query reads the driver's tables (through the fixture views of
``cadenza.sources.fixtures``) whole.  Floating results are rounded to 6
decimals on both sides; integer counts are BIGINT and ranks INTEGER on
both sides; ties are broken by id ascending in query and oracle alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.columns import confidence, hash_user_id
from cadenza.operators import daily as DY
from cadenza.operators import explore as X
from cadenza.operators import itemindex as IX
from cadenza.operators import metrics as M
from cadenza.operators import prepare as P
from cadenza.session import scratch_path
from cadenza.sources import layout as LY
from cadenza.sources.fixtures import table, view, with_views
from cadenza.sources.interactions import conform_interactions, read_interactions, write_interactions

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

K = 5  # list length used by the metric queries


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, list(views)) if views else sql.strip()
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- sources / scalar

@register("scan_interactions", "SELECT * FROM interactions", ("interactions",))
def q_scan(spark, d):
    """S6 then S1: written as CSV to the shared folder and read back from there."""
    path = scratch_path(spark, "interactions")
    write_interactions(conform_interactions(view(spark, d, "interactions")), path, "csv")
    return read_interactions(spark, path, "csv")


@register("scan_interactions_parquet", "SELECT * FROM interactions", ("interactions",))
def q_scan_parquet(spark, d):
    """The same by way of Parquet, one folder a year."""
    path = scratch_path(spark, "interactions")
    write_interactions(conform_interactions(view(spark, d, "interactions")), path, partition_by_year=True)
    return read_interactions(spark, path, "parquet")


@register("hash_user_id", """
SELECT c_custkey AS user_index, substring(sha256(concat('user_', CAST(c_custkey AS VARCHAR))), 1, 8) AS user_id
FROM customer""")
def q_hash(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("user_index"), hash_user_id("c_custkey").alias("user_id"))


# ---------------------------------------------------------------- prepare

@register("interaction_triples", """
SELECT user_id, artist, CAST(sum(play_count) AS BIGINT) AS strength
FROM interactions GROUP BY user_id, artist""", ("interactions",))
def q_triples(spark, d):
    return P.interaction_triples(view(spark, d, "interactions"))


@register("bucketed_triples", """
SELECT user_id, artist, CAST(sum(play_count) AS BIGINT) AS strength, 0 AS exchanges
FROM interactions GROUP BY user_id, artist""", ("interactions",))
def q_bucketed_triples(spark, d):
    """S6 and S1 by the bucketed layout; A1 on it, with the exchanges of its plan."""
    path = scratch_path(spark, "bucketed")
    rows = LY.write_bucketed(view(spark, d, "interactions"), "cadenza_" + path.rsplit("-", 1)[1], path, 16)
    cells = P.interaction_triples(rows)
    return cells.withColumn("exchanges", F.lit(cells._jdf.queryExecution().executedPlan().toString().count("Exchange ")))


@register("confidence", """
SELECT user_id, artist, round(1.0 + 0.4 * CAST(sum(play_count) AS DOUBLE), 6) AS confidence
FROM interactions GROUP BY user_id, artist""", ("interactions",))
def q_confidence(spark, d):
    t = P.interaction_triples(view(spark, d, "interactions"))
    return t.select("user_id", "artist", r6(confidence("strength", 0.4)).alias("confidence"))


@register("index_users", """
SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS user_idx
FROM (SELECT DISTINCT user_id FROM interactions)""", ("interactions",))
def q_index_users(spark, d):
    return P.index_ids(view(spark, d, "interactions"), "user_id", "user_idx")


@register("index_items", """
SELECT artist, CAST(row_number() OVER (ORDER BY artist) - 1 AS INTEGER) AS item_idx
FROM (SELECT DISTINCT artist FROM interactions)""", ("interactions",))
def q_index_items(spark, d):
    return P.index_ids(view(spark, d, "interactions"), "artist", "item_idx")


@register("split_by_date", """
SELECT *, CASE WHEN interaction_date < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split
FROM interactions WHERE interaction_date IS NOT NULL""", ("interactions",))
def q_split_date(spark, d):
    return P.label_split(view(spark, d, "interactions"), split_date="1999-01-01")


_RATIO_DATE = """
split_point AS (
  SELECT d AS split_date FROM (
    SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n
    FROM (SELECT DISTINCT interaction_date AS d FROM interactions WHERE interaction_date IS NOT NULL))
  WHERE i = least(CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT), n - 1))"""


def ratio_split_sql() -> str:
    """The start of an oracle: the interactions and their split date."""
    return f"{with_views('SELECT 1', ['interactions']).rsplit(chr(10) + 'SELECT 1', 1)[0]},\n{_RATIO_DATE.strip()}"


@register("split_by_ratio", f"""
, {_RATIO_DATE.strip()}
SELECT i.*, CASE WHEN i.interaction_date < s.split_date THEN 'train' ELSE 'test' END AS split
FROM interactions i CROSS JOIN split_point s WHERE i.interaction_date IS NOT NULL""", ())
def q_split_ratio(spark, d):
    return P.label_split(view(spark, d, "interactions"), train_ratio=0.8)


@register("relevant_items", f"""
, {_RATIO_DATE.strip()},
train AS (SELECT i.* FROM interactions i, split_point s WHERE i.interaction_date < s.split_date),
test AS (SELECT i.* FROM interactions i, split_point s WHERE i.interaction_date >= s.split_date)
SELECT DISTINCT user_id, artist FROM test WHERE user_id IN (SELECT user_id FROM train)""", ())
def q_relevant(spark, d):
    return P.prepare_evaluation_data(view(spark, d, "interactions"), train_ratio=0.8).relevant


@register("split_stats", f"""
, {_RATIO_DATE.strip()},
lab AS (SELECT i.*, CASE WHEN i.interaction_date < s.split_date THEN 'train' ELSE 'test' END AS split
        FROM interactions i CROSS JOIN split_point s WHERE i.interaction_date IS NOT NULL),
tr AS (SELECT count(*) AS n, count(DISTINCT user_id) AS u, count(DISTINCT artist) AS a,
              min(interaction_date) AS lo, max(interaction_date) AS hi FROM lab WHERE split = 'train'),
te AS (SELECT count(*) AS n, count(DISTINCT user_id) AS u, count(DISTINCT artist) AS a,
              min(interaction_date) AS lo, max(interaction_date) AS hi FROM lab WHERE split = 'test')
SELECT tr.n AS train_interactions, tr.u AS train_users, tr.a AS train_items,
       tr.lo AS train_min_date, tr.hi AS train_max_date,
       te.n AS test_interactions, te.u AS test_users, te.a AS test_items,
       te.lo AS test_min_date, te.hi AS test_max_date,
       (SELECT count(*) FROM (SELECT user_id FROM lab GROUP BY user_id HAVING count(DISTINCT split) = 2)) AS common_users,
       (SELECT count(*) FROM (SELECT artist FROM lab GROUP BY artist HAVING count(DISTINCT split) = 2)) AS common_items
FROM tr CROSS JOIN te""", ())
def q_split_stats(spark, d):
    return X.split_stats(P.label_split(view(spark, d, "interactions"), train_ratio=0.8))


@register("split_stats_days", "", ())
def q_split_stats_days(spark, d):
    """A12 from one table of sketches per day, written once and read back."""
    path = scratch_path(spark, "days")
    DY.daily_sketches(view(spark, d, "interactions")).write.parquet(path)
    return DY.split_stats_from_days(spark.read.parquet(path), train_ratio=0.8)


ORACLE["split_stats_days"] = ORACLE["split_stats"]


@register("dataset_summary_days", """
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT artist) AS n_items, count(*) AS n_rows
FROM interactions WHERE interaction_date IS NOT NULL""", ("interactions",))
def q_summary_days(spark, d):
    """A7 from the days' sketches."""
    return DY.summary_from_days(DY.daily_sketches(view(spark, d, "interactions")))


# the ratio-split oracles continue a WITH that names the view first
for _n in ("split_by_ratio", "relevant_items", "split_stats", "split_stats_days"):
    ORACLE[_n] = with_views("SELECT 1", ["interactions"]).rsplit("\nSELECT 1", 1)[0] + ORACLE[_n]


# ---------------------------------------------------------------- explore

@register("user_history", """
SELECT user_id, artist, play_count,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY play_count DESC, artist) AS INTEGER) AS rank
FROM interactions""", ("interactions",))
def q_history(spark, d):
    return X.user_history(view(spark, d, "interactions"))


@register("user_history_genre", """
SELECT * FROM (
  SELECT user_id, artist, play_count, genre,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY play_count DESC, artist, genre) AS INTEGER) AS rank
  FROM interactions) WHERE rank <= 20""", ("interactions",))
def q_history_genre(spark, d):
    return X.user_history_genre(view(spark, d, "interactions"), limit=20)


@register("distinct_users", "SELECT DISTINCT user_id FROM interactions", ("interactions",))
def q_distinct_users(spark, d):
    return X.distinct_values(view(spark, d, "interactions"), "user_id")


@register("distinct_items", "SELECT DISTINCT artist FROM interactions", ("interactions",))
def q_distinct_items(spark, d):
    return X.distinct_values(view(spark, d, "interactions"), "artist")


_WANTED = [" 1", "2 ", "17", "  100  ", "1999", "no such item"]


@register("items_in_list", """
SELECT * FROM interactions WHERE artist IN ('1', '2', '17', '100', '1999', 'no such item')""",
          ("interactions",))
def q_items_in_list(spark, d):
    return X.items_in_list(view(spark, d, "interactions"), _WANTED)


_BRANDS = [" Brand#3", "Brand#14 ", "Brand#22", "Brand#3"]


@register("users_by_all_items", """
SELECT user_id FROM interactions_dense WHERE artist IN ('Brand#3', 'Brand#14', 'Brand#22')
GROUP BY user_id HAVING count(DISTINCT artist) = 3""", ("interactions_dense",))
def q_users_all_items(spark, d):
    return X.users_by_all_items(view(spark, d, "interactions_dense"), _BRANDS)


# wanted lists: the brands of each customer's latest order
_LISTS = """
orders_of AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth
              FROM orders),
lists AS (SELECT DISTINCT o_custkey AS list_id, p_brand AS artist FROM orders_of
          JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE nth = 1)"""


def _latest_brands(spark, d):
    latest = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("l_orderkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(latest, "l_orderkey")
    return lines.join(table(spark, d, "part"), "p_partkey").select(
        F.col("o_custkey").alias("list_id"), F.col("p_brand").alias("artist")).distinct()


@register("users_by_many_lists", f"""
, {_LISTS.strip()},
have AS (SELECT DISTINCT user_id, artist FROM interactions_dense),
sizes AS (SELECT list_id, count(*) AS n_items FROM lists GROUP BY list_id),
met AS (SELECT l.list_id, h.user_id FROM lists l JOIN have h USING (artist) JOIN sizes s USING (list_id)
        GROUP BY l.list_id, h.user_id, s.n_items HAVING count(*) = s.n_items)
SELECT s.list_id, s.n_items, count(m.user_id) AS n_users FROM sizes s LEFT JOIN met m USING (list_id) GROUP BY s.list_id, s.n_items""", ())
def q_users_many_lists(spark, d):
    """J1 for every customer's list in one pass over the bitmap index."""
    _, index = IX.build(view(spark, d, "interactions_dense"))
    return IX.count_by_lists(index, _latest_brands(spark, d))


@register("users_by_index", ORACLE["users_by_all_items"])
def q_users_by_index(spark, d):
    """J1 of one list by the index."""
    users, index = IX.build(view(spark, d, "interactions_dense"))
    wanted = spark.createDataFrame([(1, b) for b in _BRANDS], "list_id int, artist string")
    return IX.users_by_lists(index, wanted, users).select("user_id")


ORACLE["users_by_many_lists"] = with_views("SELECT 1", ["interactions_dense"]).rsplit("\nSELECT 1", 1)[0] + "\n" + ORACLE["users_by_many_lists"]


_DEMO = """
demo AS (SELECT user_id, gender, age FROM (
  SELECT user_id, gender, age,
         row_number() OVER (PARTITION BY user_id ORDER BY interaction_date, gender, age) AS rn
  FROM {src}) WHERE rn = 1)"""


@register("users_by_items_demo", ", " + _DEMO.format(src="interactions_dense").strip() + """
SELECT user_id, gender, age FROM demo
WHERE gender = 'BUILDING' AND user_id IN (
  SELECT user_id FROM interactions_dense WHERE artist IN ('Brand#3', 'Brand#14', 'Brand#22')
  GROUP BY user_id HAVING count(DISTINCT artist) = 3)""")
def q_users_items_demo(spark, d):
    return X.users_by_items_and_demographics(view(spark, d, "interactions_dense"), _BRANDS,
                                             gender="BUILDING", age="")


@register("user_demographics", ", " + _DEMO.format(src="interactions").strip() + """
SELECT * FROM demo""")
def q_demographics(spark, d):
    return X.user_demographics(view(spark, d, "interactions"))


@register("demographic_domains", ", " + _DEMO.format(src="interactions").strip() + """
SELECT DISTINCT 'gender' AS field, gender AS value FROM demo WHERE gender IS NOT NULL
UNION ALL
SELECT DISTINCT 'age' AS field, age AS value FROM demo WHERE age IS NOT NULL""")
def q_domains(spark, d):
    return X.demographic_domains(view(spark, d, "interactions"))


for _n in ("users_by_items_demo", "user_demographics", "demographic_domains"):
    _v = "interactions_dense" if _n == "users_by_items_demo" else "interactions"
    ORACLE[_n] = with_views("SELECT 1", [_v]).rsplit("\nSELECT 1", 1)[0] + ORACLE[_n]


@register("item_popularity", """
SELECT artist, round(t / max(t) OVER (), 6) AS popularity
FROM (SELECT artist, CAST(sum(play_count) AS DOUBLE) AS t FROM interactions GROUP BY artist)""",
          ("interactions",))
def q_popularity(spark, d):
    return rounded(X.item_popularity(view(spark, d, "interactions")), "popularity")


@register("item_genre", """
SELECT artist, coalesce(min(genre), 'Unknown') AS genre FROM interactions GROUP BY artist""",
          ("interactions",))
def q_item_genre(spark, d):
    return X.item_genre(view(spark, d, "interactions"))


@register("dataset_summary", """
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT artist) AS n_items, count(*) AS n_rows
FROM interactions""", ("interactions",))
def q_summary(spark, d):
    return X.dataset_summary(view(spark, d, "interactions"))


@register("dataset_distribution", """
SELECT 'gender' AS field, gender AS value, count(*) AS n_rows, round(avg(play_count), 6) AS mean_plays,
       CAST(sum(play_count) AS BIGINT) AS total_plays FROM interactions GROUP BY gender
UNION ALL
SELECT 'age', age, count(*), round(avg(play_count), 6), CAST(sum(play_count) AS BIGINT) FROM interactions GROUP BY age
UNION ALL
SELECT 'genre', genre, count(*), round(avg(play_count), 6), CAST(sum(play_count) AS BIGINT) FROM interactions GROUP BY genre
UNION ALL
SELECT 'all', NULL, count(*), round(avg(play_count), 6), CAST(sum(play_count) AS BIGINT) FROM interactions""",
          ("interactions",))
def q_distribution(spark, d):
    return rounded(X.dataset_distribution(view(spark, d, "interactions")), "mean_plays")


@register("user_stats", """
SELECT user_id, count(*) AS n_rows, round(avg(play_count), 6) AS mean_plays,
       CAST(sum(play_count) AS BIGINT) AS total_plays, count(DISTINCT genre) AS n_genres
FROM interactions GROUP BY user_id""", ("interactions",))
def q_user_stats(spark, d):
    return rounded(X.user_stats(view(spark, d, "interactions")), "mean_plays")


@register("user_genre_plays", """
SELECT * FROM (
  SELECT user_id, genre, plays,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, genre) AS INTEGER) AS rank
  FROM (SELECT user_id, genre, CAST(sum(play_count) AS BIGINT) AS plays FROM interactions GROUP BY user_id, genre))
WHERE rank <= 10""", ("interactions",))
def q_user_genre_plays(spark, d):
    return X.user_genre_plays(view(spark, d, "interactions"), top=10)


@register("genre_item_counts", """
SELECT genre, count(*) AS n_items FROM (
  SELECT artist, coalesce(min(genre), 'Unknown') AS genre FROM interactions GROUP BY artist)
GROUP BY genre""", ("interactions",))
def q_genre_counts(spark, d):
    return X.genre_item_counts(view(spark, d, "interactions"))


def _dense_pairs(spark, d) -> DataFrame:
    """Pairs of neighbouring customer ids present in the dense view."""
    u = X.distinct_values(view(spark, d, "interactions_dense"), "user_id")
    nxt = u.select(F.col("user_id").alias("user_id2"),
                   (F.col("user_id").cast("long") - 1).cast("string").alias("user_id1"))
    return u.withColumnRenamed("user_id", "user_id1").join(nxt, "user_id1")


_DENSE_PAIRS = """
pairs AS (SELECT a.user_id AS user_id1, b.user_id AS user_id2
          FROM (SELECT DISTINCT user_id FROM interactions_dense) a
          JOIN (SELECT DISTINCT user_id FROM interactions_dense) b
            ON CAST(CAST(a.user_id AS BIGINT) + 1 AS VARCHAR) = b.user_id)"""


@register("common_items", ", " + _DENSE_PAIRS.strip() + """,
t AS (SELECT user_id, artist, CAST(sum(play_count) AS BIGINT) AS plays FROM interactions_dense GROUP BY user_id, artist)
SELECT * FROM (
  SELECT p.user_id1, p.user_id2,
         CAST(row_number() OVER (PARTITION BY p.user_id1, p.user_id2 ORDER BY a.plays + b.plays DESC, a.artist) AS INTEGER) AS rank,
         a.artist, a.plays AS plays1, b.plays AS plays2
  FROM pairs p JOIN t a ON a.user_id = p.user_id1 JOIN t b ON b.user_id = p.user_id2 AND b.artist = a.artist)
WHERE rank <= 10""")
def q_common_items(spark, d):
    return X.common_items(view(spark, d, "interactions_dense"), _dense_pairs(spark, d), top_n=10)


ORACLE["common_items"] = with_views("SELECT 1", ["interactions_dense"]).rsplit("\nSELECT 1", 1)[0] \
    + ORACLE["common_items"]


def _vec_pairs(spark, d) -> DataFrame:
    u = view(spark, d, "user_vecs").select("user_id")
    return (u.withColumnRenamed("user_id", "user_id1")
             .join(u.select(F.col("user_id").alias("user_id2"),
                            (F.col("user_id") - 1).alias("user_id1")), "user_id1"))


@register("user_comparison", """
, pairs AS (SELECT a.user_id AS user_id1, b.user_id AS user_id2 FROM user_vecs a JOIN user_vecs b ON b.user_id = a.user_id + 1),
ui AS (SELECT DISTINCT user_id, item_id FROM seen),
ug AS (SELECT DISTINCT ui.user_id, v.genre FROM ui JOIN item_vecs v ON v.item_id = ui.item_id WHERE v.genre IS NOT NULL),
ci AS (SELECT p.user_id1, p.user_id2, count(*) AS n FROM pairs p JOIN ui a ON a.user_id = p.user_id1
       JOIN ui b ON b.user_id = p.user_id2 AND b.item_id = a.item_id GROUP BY p.user_id1, p.user_id2),
cg AS (SELECT p.user_id1, p.user_id2, count(*) AS n FROM pairs p JOIN ug a ON a.user_id = p.user_id1
       JOIN ug b ON b.user_id = p.user_id2 AND b.genre = a.genre GROUP BY p.user_id1, p.user_id2)
SELECT p.user_id1, p.user_id2, coalesce(ci.n, 0) AS n_common_items, coalesce(cg.n, 0) AS n_common_genres,
       round(list_cosine_similarity(v1.embedding, v2.embedding), 6) AS cosine
FROM pairs p
LEFT JOIN ci ON ci.user_id1 = p.user_id1 AND ci.user_id2 = p.user_id2
LEFT JOIN cg ON cg.user_id1 = p.user_id1 AND cg.user_id2 = p.user_id2
JOIN user_vecs v1 ON v1.user_id = p.user_id1 JOIN user_vecs v2 ON v2.user_id = p.user_id2""")
def q_user_comparison(spark, d):
    out = X.user_comparison(view(spark, d, "seen"), _vec_pairs(spark, d), view(spark, d, "user_vecs"),
                            genres=view(spark, d, "item_vecs").select("item_id", "genre"),
                            item_col="item_id", vec_col="embedding")
    return rounded(out, "cosine")


ORACLE["user_comparison"] = with_views("SELECT 1", ["user_vecs", "seen", "item_vecs"]) \
    .rsplit("\nSELECT 1", 1)[0] + ORACLE["user_comparison"]


# ---------------------------------------------------------------- metrics on fixed lists

_FX = ("recs_fx", "relevant_fx", "genre_fx", "seen", "item_vecs")


def _fx(spark, d):
    return (view(spark, d, "recs_fx"), view(spark, d, "relevant_fx"), view(spark, d, "genre_fx"))


_PER_USER = """
rel AS (SELECT user_id, count(*) AS n_rel FROM relevant_fx GROUP BY user_id),
hits AS (SELECT r.user_id, count(*) AS n_hits, sum(1.0 / log2(r.rank + 1)) AS dcg
         FROM recs_fx r JOIN relevant_fx v ON v.user_id = r.user_id AND v.item_id = r.item_id
         WHERE r.rank <= 5 GROUP BY r.user_id),
per AS (SELECT rel.user_id,
               coalesce(hits.n_hits, 0) / 5.0 AS p,
               coalesce(hits.n_hits, 0) / CAST(rel.n_rel AS DOUBLE) AS r,
               coalesce(hits.dcg, 0) / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(5, rel.n_rel) + 1) t(i)) AS g,
               CASE WHEN coalesce(hits.n_hits, 0) > 0 THEN 1.0 ELSE 0.0 END AS h
        FROM rel LEFT JOIN hits ON hits.user_id = rel.user_id)"""


@register("precision_at_k", f", {_PER_USER.strip()}\nSELECT user_id, round(p, 6) AS precision_at_5 FROM per",
          ())
def q_precision(spark, d):
    r, v, _ = _fx(spark, d)
    return rounded(M.per_user_accuracy(r, v, K, item_col="item_id").select("user_id", "precision_at_5"),
                   "precision_at_5")


@register("recall_at_k", f", {_PER_USER.strip()}\nSELECT user_id, round(r, 6) AS recall_at_5 FROM per", ())
def q_recall(spark, d):
    r, v, _ = _fx(spark, d)
    return rounded(M.per_user_accuracy(r, v, K, item_col="item_id").select("user_id", "recall_at_5"),
                   "recall_at_5")


@register("ndcg_at_k", f", {_PER_USER.strip()}\nSELECT user_id, round(g, 6) AS ndcg_at_5 FROM per", ())
def q_ndcg(spark, d):
    r, v, _ = _fx(spark, d)
    return rounded(M.per_user_accuracy(r, v, K, item_col="item_id").select("user_id", "ndcg_at_5"),
                   "ndcg_at_5")


@register("hit_rate_at_k", f", {_PER_USER.strip()}\nSELECT user_id, round(h, 6) AS hit_rate_at_5 FROM per",
          ())
def q_hit(spark, d):
    r, v, _ = _fx(spark, d)
    return rounded(M.per_user_accuracy(r, v, K, item_col="item_id").select("user_id", "hit_rate_at_5"),
                   "hit_rate_at_5")


_COVERAGE = """
(SELECT count(DISTINCT item_id) FROM recs_fx WHERE rank <= 5) / CAST((SELECT count(DISTINCT item_id) FROM seen) AS DOUBLE)"""


@register("coverage", f"SELECT round({_COVERAGE.strip()}, 6) AS coverage", ("recs_fx", "seen"))
def q_coverage(spark, d):
    r, _, _ = _fx(spark, d)
    return rounded(M.coverage(r, view(spark, d, "seen"), K, "item_id"), "coverage")


@register("accuracy_metrics", f", {_PER_USER.strip()}\n" + f"""
SELECT round(avg(p), 6) AS precision_at_5, round(avg(r), 6) AS recall_at_5, round(avg(g), 6) AS ndcg_at_5,
       round(avg(h), 6) AS hit_rate_at_5, round({_COVERAGE.strip()}, 6) AS coverage FROM per""", ())
def q_accuracy(spark, d):
    r, v, _ = _fx(spark, d)
    out = M.accuracy_metrics(r, v, view(spark, d, "seen"), K, item_col="item_id")
    return rounded(out, *out.columns)


_GENRE = "gm AS (SELECT item_id, genre FROM genre_fx WHERE genre IS NOT NULL)"
_ILD = """
ild AS (SELECT user_id, CASE WHEN sum(ng) < 2 THEN 0.0
               ELSE 1.0 - sum(ng * (ng - 1)) / CAST(sum(ng) * (sum(ng) - 1) AS DOUBLE) END AS v
        FROM (SELECT r.user_id, coalesce(gm.genre, '') AS g, count(*) AS ng
              FROM recs_fx r LEFT JOIN gm ON gm.item_id = r.item_id GROUP BY r.user_id, coalesce(gm.genre, ''))
        GROUP BY user_id)"""


@register("intra_list_diversity", f", {_GENRE}, {_ILD.strip()}\nSELECT user_id, round(v, 6) AS intra_list_diversity FROM ild",
          ())
def q_ild(spark, d):
    r, _, g = _fx(spark, d)
    return rounded(M.intra_list_diversity(r, g, item_col="item_id"), "intra_list_diversity")


_ILD_PAIRS = """
pr AS (SELECT a.user_id, {dist} AS dist
       FROM recs_fx a JOIN recs_fx b ON b.user_id = a.user_id AND a.rank < b.rank
       JOIN item_vecs va ON va.item_id = a.item_id JOIN item_vecs vb ON vb.item_id = b.item_id),
u AS (SELECT DISTINCT user_id FROM recs_fx r WHERE EXISTS (SELECT 1 FROM item_vecs v WHERE v.item_id = r.item_id))
SELECT u.user_id, round(coalesce(avg(pr.dist), 0.0), 6) AS intra_list_diversity
FROM u LEFT JOIN pr ON pr.user_id = u.user_id GROUP BY u.user_id"""


@register("ild_cosine", ", " + _ILD_PAIRS.format(
    dist="1.0 - list_cosine_similarity(va.embedding, vb.embedding)").strip(), ())
def q_ild_cos(spark, d):
    r, _, _ = _fx(spark, d)
    f = view(spark, d, "item_vecs").select("item_id", F.col("embedding").alias("features"))
    return rounded(M.intra_list_diversity_features(r, f, "cosine", item_col="item_id"),
                   "intra_list_diversity")


@register("ild_euclidean", ", " + _ILD_PAIRS.format(
    dist="list_distance(va.embedding, vb.embedding)").strip(), ())
def q_ild_euc(spark, d):
    r, _, _ = _fx(spark, d)
    f = view(spark, d, "item_vecs").select("item_id", F.col("embedding").alias("features"))
    return rounded(M.intra_list_diversity_features(r, f, "euclidean", item_col="item_id"),
                   "intra_list_diversity")


for _n in ("ild_cosine", "ild_euclidean"):
    ORACLE[_n] = with_views("SELECT 1", ["recs_fx", "item_vecs"]).rsplit("\nSELECT 1", 1)[0] + ORACLE[_n]

_CATCOV = """
(SELECT count(*) FROM (SELECT DISTINCT item_id FROM recs_fx) r WHERE item_id IN (SELECT item_id FROM seen))
  / CAST((SELECT count(DISTINCT item_id) FROM seen) AS DOUBLE)"""


@register("catalog_coverage", f"SELECT round({_CATCOV.strip()}, 6) AS catalog_coverage", ("recs_fx", "seen"))
def q_catcov(spark, d):
    r, _, _ = _fx(spark, d)
    return rounded(M.catalog_coverage(r, view(spark, d, "seen"), "item_id"), "catalog_coverage")


_GCOV = """
gcov AS (SELECT r.user_id, count(DISTINCT gm.genre) / CAST((SELECT count(DISTINCT genre) FROM gm) AS DOUBLE) AS v
         FROM recs_fx r LEFT JOIN gm ON gm.item_id = r.item_id GROUP BY r.user_id)"""


@register("genre_coverage", f", {_GENRE}, {_GCOV.strip()}\nSELECT user_id, round(v, 6) AS genre_coverage FROM gcov", ())
def q_gcov(spark, d):
    r, _, g = _fx(spark, d)
    return rounded(M.genre_coverage(r, g, item_col="item_id"), "genre_coverage")


_ENT = """
n AS (SELECT user_id, count(*) AS n FROM recs_fx GROUP BY user_id),
ent AS (SELECT n.user_id, coalesce(e.v, 0.0) AS v FROM n LEFT JOIN (
          SELECT c.user_id, sum(-(c.ng / CAST(n.n AS DOUBLE)) * log2(c.ng / CAST(n.n AS DOUBLE))) AS v
          FROM (SELECT r.user_id, gm.genre, count(*) AS ng FROM recs_fx r JOIN gm ON gm.item_id = r.item_id
                GROUP BY r.user_id, gm.genre) c JOIN n ON n.user_id = c.user_id GROUP BY c.user_id) e
        ON e.user_id = n.user_id)"""


@register("shannon_entropy", f", {_GENRE}, {_ENT.strip()}\nSELECT user_id, round(v, 6) AS shannon_entropy FROM ent", ())
def q_entropy(spark, d):
    r, _, g = _fx(spark, d)
    return rounded(M.shannon_entropy(r, g, item_col="item_id"), "shannon_entropy")


@register("rec_counts", "SELECT item_id, count(*) AS n_recommended FROM recs_fx GROUP BY item_id", ("recs_fx",))
def q_rec_counts(spark, d):
    r, _, _ = _fx(spark, d)
    return M.rec_counts(r, "item_id")


_GINI = """
cnt AS (SELECT item_id, count(*) AS c FROM recs_fx GROUP BY item_id),
ranked AS (SELECT c, row_number() OVER (ORDER BY c, item_id) AS i FROM cnt),
gini AS (SELECT CASE WHEN count(*) = 0 OR sum(c) = 0 THEN 0.0 ELSE
           2.0 * sum(i * c) / (count(*) * CAST(sum(c) AS DOUBLE)) - (count(*) + 1) / CAST(count(*) AS DOUBLE) END AS v
         FROM ranked)"""


@register("gini", f", {_GINI.strip()}\nSELECT round(v, 6) AS gini_coefficient FROM gini", ())
def q_gini(spark, d):
    r, _, _ = _fx(spark, d)
    return rounded(M.gini(r, "item_id"), "gini_coefficient")


_NOV = """
pop AS (SELECT item_id, t / max(t) OVER () AS popularity
        FROM (SELECT item_id, CAST(sum(play_count) AS DOUBLE) AS t FROM seen GROUP BY item_id)),
nov AS (SELECT u.user_id, coalesce(x.v, 0.0) AS v FROM (SELECT DISTINCT user_id FROM recs_fx) u LEFT JOIN (
          SELECT r.user_id, avg(-log2(greatest(p.popularity, 1e-10))) AS v
          FROM recs_fx r JOIN pop p ON p.item_id = r.item_id GROUP BY r.user_id) x ON x.user_id = u.user_id)"""


@register("novelty", f", {_NOV.strip()}\nSELECT user_id, round(v, 6) AS novelty_score FROM nov", ())
def q_novelty(spark, d):
    r, _, _ = _fx(spark, d)
    pop = X.item_popularity(view(spark, d, "seen"), "item_id")
    return rounded(M.novelty(r, pop, item_col="item_id"), "novelty_score")


_PROFILE = """
tot AS (SELECT user_id, CAST(sum(play_count) AS DOUBLE) AS total FROM seen GROUP BY user_id),
prof_long AS (SELECT s.user_id, e.pos, sum(s.play_count * e.x) / max(tot.total) AS v
              FROM seen s JOIN (SELECT item_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM item_vecs) e
                ON e.item_id = s.item_id
              JOIN tot ON tot.user_id = s.user_id GROUP BY s.user_id, e.pos)"""


@register("user_profile", f", {_PROFILE.strip()}\nSELECT user_id, CAST(pos AS INTEGER) AS dim, round(v, 6) AS value FROM prof_long",
          ())
def q_profile(spark, d):
    f = view(spark, d, "item_vecs").select("item_id", F.col("embedding").alias("features"))
    prof = M.user_profile(view(spark, d, "seen"), f, item_col="item_id")
    return prof.select("user_id", F.posexplode("profile").alias("dim", "value")).select(
        "user_id", (F.col("dim") + 1).cast("int").alias("dim"), r6("value").alias("value"))


_UNEXP = """
prof AS (SELECT user_id, list(v ORDER BY pos) AS profile FROM prof_long GROUP BY user_id),
ux AS (SELECT u.user_id, coalesce(x.v, 0.0) AS v
       FROM (SELECT DISTINCT user_id FROM recs_fx WHERE user_id IN (SELECT user_id FROM prof)) u LEFT JOIN (
         SELECT r.user_id, avg(greatest(0.0, 0.5 - coalesce(list_cosine_similarity(p.profile, iv.embedding), 0.0))) AS v
         FROM recs_fx r JOIN prof p ON p.user_id = r.user_id JOIN item_vecs iv ON iv.item_id = r.item_id
         GROUP BY r.user_id) x ON x.user_id = u.user_id)"""


@register("unexpectedness", f", {_PROFILE.strip()}, {_UNEXP.strip()}\nSELECT user_id, round(v, 6) AS unexpectedness_score FROM ux",
          ())
def q_unexpectedness(spark, d):
    r, _, _ = _fx(spark, d)
    f = view(spark, d, "item_vecs").select("item_id", F.col("embedding").alias("features"))
    prof = M.user_profile(view(spark, d, "seen"), f, item_col="item_id")
    return rounded(M.unexpectedness(r, prof, f, 0.5, item_col="item_id"), "unexpectedness_score")


_SER_SELECT = f"""
SELECT round((SELECT coalesce(avg(v), 0.0) FROM ild), 6) AS intra_list_diversity,
       round({_CATCOV.strip()}, 6) AS catalog_coverage,
       round((SELECT coalesce(avg(v), 0.0) FROM gcov), 6) AS genre_coverage,
       round((SELECT coalesce(avg(v), 0.0) FROM ent), 6) AS shannon_entropy,
       round((SELECT v FROM gini), 6) AS gini_coefficient,
       round((SELECT coalesce(avg(v), 0.0) FROM nov), 6) AS novelty_score,
       round((SELECT coalesce(avg(v), 0.0) FROM ux), 6) AS unexpectedness_score"""

_SER_CTES = ", ".join(s.strip() for s in (_GENRE, _ILD, _GCOV, _ENT, _GINI, _NOV, _PROFILE, _UNEXP))


def _ser(spark, d):
    r, _, g = _fx(spark, d)
    f = view(spark, d, "item_vecs").select("item_id", F.col("embedding").alias("features"))
    return M.serendipity_metrics(r, view(spark, d, "seen"), g, view(spark, d, "seen"), f,
                                 item_col="item_id")


@register("serendipity_metrics", f", {_SER_CTES}\n{_SER_SELECT.strip()}", ())
def q_serendipity(spark, d):
    out = _ser(spark, d)
    return rounded(out, *out.columns)


@register("all_metrics", f", {_PER_USER.strip()}, {_SER_CTES}\n" + f"""
SELECT round((SELECT avg(p) FROM per), 6) AS precision_at_5, round((SELECT avg(r) FROM per), 6) AS recall_at_5,
       round((SELECT avg(g) FROM per), 6) AS ndcg_at_5, round((SELECT avg(h) FROM per), 6) AS hit_rate_at_5,
       round({_COVERAGE.strip()}, 6) AS coverage, * FROM ({_SER_SELECT.strip()})""", ())
def q_all_metrics(spark, d):
    r, v, g = _fx(spark, d)
    seen = view(spark, d, "seen")
    f = view(spark, d, "item_vecs").select("item_id", F.col("embedding").alias("features"))
    out = M.all_metrics(r, v, seen, K, include_serendipity=True, interactions=seen, genres=g,
                        features=f, item_col="item_id")
    return rounded(out, *out.columns)


for _n in ("precision_at_k", "recall_at_k", "ndcg_at_k", "hit_rate_at_k", "accuracy_metrics",
           "intra_list_diversity", "genre_coverage", "shannon_entropy", "gini", "novelty",
           "user_profile", "unexpectedness", "serendipity_metrics", "all_metrics"):
    ORACLE[_n] = with_views("SELECT 1", list(_FX)).rsplit("\nSELECT 1", 1)[0] + ORACLE[_n]


# more checked queries register themselves on import
from cadenza.plans import registry_vectors  # noqa: E402,F401
from cadenza.plans import registry_results  # noqa: E402,F401
from cadenza.plans import registry_models  # noqa: E402,F401
from cadenza.plans import registry_plugins  # noqa: E402,F401
