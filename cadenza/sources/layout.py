"""Interactions laid out by user.

A table bucketed by user and sorted by (user, item) within a bucket is read
as already partitioned: per-user and per-(user, item) aggregates, windows by
user and joins on the user need no shuffle of it.  The files and a note of the
layout lie in one folder; ``attach`` makes them known to a session whose
catalogue does not hold the table yet.

One bucket is one task when read.  A user with a large share of all rows is
written in parts (the rebalance hint), but read as one bucket: for tables with such
users keep the plain layout, or take buckets by (user, item).

A join on user and item of two tables bucketed by the user alone is free of
shuffles only with ``spark.sql.requireAllClusterKeysForCoPartition`` set to
false.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from cadenza.sources import commits


def _quoted(*names: str) -> str:
    return ", ".join("`" + n.replace("`", "``") + "`" for n in names)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, user_col: str = "user_id",
                   item_col: str = "artist") -> DataFrame:
    """Write ``df`` as table ``table`` below ``path`` and return it as read."""
    dealt = df.hint("rebalance", buckets, user_col)
    dealt.write.bucketBy(buckets, user_col).sortBy(user_col, item_col).option("path", path).saveAsTable(table)
    note = {"schema": df.schema.jsonValue(), "buckets": buckets, "user": user_col, "item": item_col}
    commits.publish_file(df.sparkSession, f"{path.rstrip('/')}/_layout.json", json.dumps(note))
    return df.sparkSession.table(table)


def attach(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The table written at ``path``, under the name ``table``."""
    if not spark.catalog.tableExists(table):
        note = json.loads(commits.read_text(spark, f"{path.rstrip('/')}/_layout.json"))
        columns = ", ".join(f"{_quoted(f['name'])} {f['type'] if isinstance(f['type'], str) else 'string'}"
                            for f in note["schema"]["fields"])
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({_quoted(note['user'])}) "
                  f"SORTED BY ({_quoted(note['user'], note['item'])}) INTO {int(note['buckets'])} BUCKETS "
                  f"LOCATION '{path}'")
    return spark.table(table)
