"""Stand-in inputs derived from the driver's test tables.

Each view is one SQL text with ``{table}`` placeholders.  Spark runs it
through ``spark.sql(text, table=DataFrame)`` (no global temp views);
the DuckDB oracle gets the same text with the braces removed, wrapped
as a CTE.  So the Spark side and the oracle read identical inputs.

Every view reads its base tables whole: no id bound, no cap.  Ids of the
events table are spread over the domains of the embeddings and the parts,
which grow with their tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

VIEWS: dict[str, str] = {
    # one row per order line: user = customer, item = part, genre = part type
    "interactions": """
SELECT CAST(o_custkey AS STRING) AS user_id, c_mktsegment AS gender, n_name AS age,
       CAST(l_partkey AS STRING) AS artist, p_type AS genre,
       CAST(o_orderdate AS DATE) AS interaction_date, CAST(l_quantity AS BIGINT) AS play_count
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey
JOIN {part} ON l_partkey = p_partkey""",
    # 25 brands as items: most users have seen most of the catalogue
    "interactions_dense": """
SELECT CAST(o_custkey AS STRING) AS user_id, c_mktsegment AS gender, n_name AS age,
       p_brand AS artist, concat('g', CAST(length(p_brand) + ascii(substring(p_brand, 7, 1)) % 5 AS STRING)) AS genre,
       CAST(o_orderdate AS DATE) AS interaction_date, CAST(l_quantity AS BIGINT) AS play_count
FROM {lineitem}
JOIN {orders} ON l_orderkey = o_orderkey
JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey
JOIN {part} ON l_partkey = p_partkey""",
    # every embedding is an item and a user
    "item_vecs": """
SELECT vec_id AS item_id, CAST(embedding AS ARRAY<DOUBLE>) AS embedding, label AS genre
FROM {embeddings}""",
    "user_vecs": """
SELECT vec_id AS user_id, CAST(embedding AS ARRAY<DOUBLE>) AS embedding
FROM {embeddings}""",
    # purchases, spread over all users and all items
    "seen": """
SELECT user_id, item_id, COUNT(*) AS play_count
FROM (SELECT (event_id * 13 + user_id) % n AS user_id, (event_id * 7) % n AS item_id
      FROM {events} CROSS JOIN (SELECT COUNT(*) AS n FROM {embeddings}) WHERE event_type = 'purchase')
GROUP BY user_id, item_id""",
    # the first ten distinct items that a user did more than view
    "recs_fx": """
SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id
FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY first_event) AS rank
      FROM (SELECT user_id, (event_id * 7) % n AS item_id, MIN(event_id) AS first_event
            FROM {events} CROSS JOIN (SELECT COUNT(*) AS n FROM {part}) WHERE event_type <> 'view'
            GROUP BY user_id, (event_id * 7) % n))
WHERE rank <= 10""",
    # the items that a user viewed; users after the last one, one per supplier, have no list
    "relevant_fx": """
SELECT DISTINCT user_id, (event_id * 7) % n AS item_id
FROM {events} CROSS JOIN (SELECT COUNT(*) AS n FROM {part}) WHERE event_type = 'view'
UNION ALL
SELECT last + s_suppkey AS user_id, s_suppkey % n AS item_id
FROM {supplier} CROSS JOIN (SELECT MAX(user_id) AS last FROM {events}) CROSS JOIN (SELECT COUNT(*) AS n FROM {part})""",
    "genre_fx": """
SELECT p_partkey AS item_id, CASE WHEN p_brand LIKE '%5' THEN NULL
       ELSE concat('g', substring(p_brand, 7, 1)) END AS genre
FROM {part}""",
    "results_fx": """
SELECT o_orderkey AS seq, o_orderpriority AS data_name, concat('model_', o_orderstatus) AS model_name,
       CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + 1 AS STRING) AS execute_date,
       concat('{"alpha": ', CASE o_custkey % 7 WHEN 0 THEN '1.0' WHEN 1 THEN '1' WHEN 2 THEN '1e-05' WHEN 3 THEN '2.675'
              ELSE concat('0.', CAST(o_custkey % 7 AS STRING)) END,
              ', "factors": ', CAST(10 * (o_custkey % 3 + 1) AS STRING), '}') AS param,
       CASE WHEN o_orderkey % 97 = 0 THEN 'not json' ELSE
         concat('{', CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('"ndcg_at_5": 0.', lpad(CAST(o_orderkey * 53 % 10000 AS STRING), 4, '0'), ', ') END,
                '"precision_at_5": ', CASE WHEN o_orderkey % 13 = 0 THEN 'NaN' ELSE
                concat('0.', lpad(CAST(o_orderkey * 37 % 10000 AS STRING), 4, '0')) END, '}') END AS metrics
FROM {orders}""",
}

_PLACEHOLDER = re.compile(r"\{(" + "|".join(BASE_TABLES) + r")\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver-generated parquet table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build fixture view ``name`` over the tables in ``sf_dir``."""
    text = VIEWS[name]
    used = sorted(set(_PLACEHOLDER.findall(text)))
    frames = {t: table(spark, sf_dir, t) for t in used}
    # spark.sql formats the text: double every literal brace, keep placeholders
    escaped = text.replace("{", "{{").replace("}", "}}")
    escaped = re.sub(r"\{\{(" + "|".join(used) + r")\}\}", r"{\1}", escaped)
    return spark.sql(escaped, **frames)


def view_sql(name: str) -> str:
    """The view text for DuckDB, where base tables are registered views."""
    text = VIEWS[name]
    # DuckDB spells the array cast with brackets
    text = text.replace("ARRAY<DOUBLE>", "DOUBLE[]")
    return _PLACEHOLDER.sub(lambda m: m.group(1), text)


def with_views(sql: str, names: list[str]) -> str:
    """Prefix ``sql`` with one CTE per fixture view it uses."""
    ctes = ",\n".join(f"{n} AS ({view_sql(n).strip()})" for n in names)
    return f"WITH {ctes}\n{sql.strip()}"
