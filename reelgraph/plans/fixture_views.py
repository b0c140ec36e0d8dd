"""Stand-ins for the domain tables over the synthetic tables, as SQL that Spark and DuckDB both run.

`{name}` in a text is another view or a synthetic table. `Views` gives DataFrames; `with_views` puts the same texts in
front of a query for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MARK = 10_000_000

VIEWS = {
    "numbers": "SELECT CAST(10 * a.n + b.n AS INT) AS n FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS a(n) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS b(n)",
    "subject": """
        SELECT p_partkey AS id, 'src_subject' AS info_source, CAST(p_partkey AS STRING) AS id_source, p_name AS title,
          CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(p_brand, ' ', p_name) END AS title_cn,
          CASE p_type WHEN 'ECONOMY' THEN 'anime' WHEN 'MEDIUM' THEN 'anime' WHEN 'STANDARD' THEN 'galgame' WHEN 'PROMO' THEN 'game' WHEN 'SMALL' THEN 'novel' ELSE 'book' END AS subject_type,
          CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(p_partkey * 37 % 2400 AS INT) END AS date,
          p_type AS platform, p_partkey % 10 = 0 AS nsfw, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS eps,
          CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE NULL END AS total_episodes,
          CASE WHEN p_partkey % 7 = 0 THEN CAST(p_partkey % 13 AS INT) ELSE NULL END AS volumes,
          p_partkey * 7919 % 100000 AS updated_minute, p_brand AS brand
        FROM {part}""",
    "episode": """
        SELECT p_partkey * 1000 + n AS id, p_partkey AS subject_id, n AS sort, CASE WHEN n % 6 = 0 THEN NULL ELSE n END AS ep_num,
          CASE WHEN n % 10 = 0 THEN 'SP' ELSE 'EP' END AS type
        FROM {part} JOIN {numbers} ON n BETWEEN 1 AND p_size""",
    "staff": "SELECT s_suppkey AS id, s_name AS name FROM {supplier}",
    "person": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM {nation}",
    "subject_staff": """
        SELECT DISTINCT l_partkey AS subject_id, l_suppkey AS staff_id, CASE l_returnflag WHEN 'R' THEN '監督' WHEN 'A' THEN '脚本' ELSE '' END AS role FROM {lineitem}""",
    "subject_character": """
        SELECT DISTINCT l_partkey AS subject_id, l_suppkey % 25 AS character_id, CASE l_linestatus WHEN 'O' THEN '主角' ELSE 'support' END AS role FROM {lineitem}""",
    "subject_actor": "SELECT DISTINCT l_partkey AS subject_id, l_suppkey % 25 AS character_id, l_suppkey AS actor_id FROM {lineitem}",
    "subject_subject": """
        SELECT DISTINCT l_partkey AS source_id, (l_partkey * 2 + l_linenumber) % (SELECT count(*) FROM {part}) AS target_id, l_returnflag AS relation FROM {lineitem}""",
    "calendar_subject": """
        SELECT id AS subject_id, CASE id % 8 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' WHEN 6 THEN 'Sunday' ELSE '' END AS weekday_en,
          p_size AS collection_doing, CASE WHEN id % 4 = 0 THEN '' ELSE concat('https://img.example.org/', id_source, '.jpg') END AS image_url
        FROM {subject} JOIN {part} ON p_partkey = id WHERE subject_type = 'anime'""",
    "profile": "SELECT c_custkey AS user_id, c_name AS nickname, CASE WHEN c_custkey % 3 = 0 THEN 'Asia/Shanghai' WHEN c_custkey % 3 = 1 THEN 'America/New_York' ELSE 'UTC' END AS zone FROM {customer}",
    "mark": """
        SELECT o_custkey * 10000000 + l_partkey AS id, o_custkey AS user_id, l_partkey AS subject_id,
          CASE max(l_returnflag) WHEN 'A' THEN 'wish' WHEN 'N' THEN 'doing' ELSE 'done' END AS status,
          CASE WHEN CAST(max(l_quantity) AS INT) % 6 = 0 THEN NULL ELSE CAST(max(l_quantity) AS INT) % 6 END AS simple_rating,
          least(round(max(l_discount) * 100, 1), 10.0) AS rating, concat('note ', max(l_returnflag)) AS comment,
          max(l_linestatus) = 'O' AS is_public, min(o_orderdate) AS created_at, max(l_shipdate) AS updated_at
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey""",
    "user_tag": "SELECT DISTINCT user_id * 1000 + CAST(substr(brand, 7) AS INT) AS id, user_id, brand AS name FROM {mark} m JOIN {subject} s ON s.id = m.subject_id",
    "mark_tag": "SELECT m.id AS mark_id, user_id * 1000 + CAST(substr(brand, 7) AS INT) AS tag_id FROM {mark} m JOIN {subject} s ON s.id = m.subject_id",
    "rating_detail": "SELECT id * 10 + n AS id, id AS mark_id, CASE n WHEN 1 THEN 'story' WHEN 2 THEN 'art' ELSE 'music' END AS key, CAST((id + n) % 11 AS DOUBLE) AS value FROM {mark} JOIN {numbers} ON n BETWEEN 1 AND id % 4",
    "progress": "SELECT m.id AS mark_id, e.id AS episode_id, TRUE AS is_finished FROM {mark} m JOIN {episode} e ON e.subject_id = m.subject_id WHERE e.sort <= m.id % 7",
    "review": "SELECT id, id AS mark_id, concat('Review ', status) AS title, comment AS content, subject_id % 2 = 0 AS is_public, created_at, updated_at FROM {mark} WHERE subject_id % 3 = 0",
    "collection": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS name, concat('order ', o_orderstatus) AS note, o_orderstatus <> 'P' AS is_public, o_orderdate AS created_at FROM {orders}",
    "item": """
        SELECT l_orderkey * 10000000 + l_partkey AS id, l_orderkey AS collection_id, min(l_linenumber) AS place, o_custkey * 10000000 + l_partkey AS mark_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey, o_custkey""",
    "follow": "SELECT user_id AS follower_id, (event_id * 7 + 3) % 100 AS following_id, min(ts) AS created_at FROM {events} WHERE event_type = 'signup' AND user_id <> (event_id * 7 + 3) % 100 GROUP BY 1, 2",
    "block": "SELECT user_id, (event_id * 11 + 5) % 100 AS target_id, min(ts) AS created_at FROM {events} WHERE event_type = 'error' AND event_id % 20 < 3 AND user_id <> (event_id * 11 + 5) % 100 GROUP BY 1, 2",
    "mute": "SELECT user_id, (event_id * 11 + 5) % 100 AS target_id, min(ts) AS created_at FROM {events} WHERE event_type = 'error' AND event_id % 20 IN (10, 11, 12) AND user_id <> (event_id * 11 + 5) % 100 GROUP BY 1, 2",
    "post": """
        SELECT doc_id AS id, doc_id % 100 AS author_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % (SELECT count(*) FROM {part}) ELSE NULL END AS subject_id,
          CASE WHEN doc_id % 2 = 0 THEN 'subject' ELSE 'status' END AS post_type, text AS content,
          CASE doc_id % 10 WHEN 0 THEN 'private' WHEN 1 THEN 'followers' ELSE 'public' END AS visibility,
          CASE WHEN doc_id % 13 = 0 THEN 'hidden' WHEN doc_id % 17 = 0 THEN 'featured' ELSE 'normal' END AS feed_policy,
          CASE WHEN doc_id % 19 = 0 THEN NULL ELSE doc_id * 31 % 5000 END AS last_activity_minute, doc_id * 7 % 4000 AS created_minute,
          CAST(doc_id % 7 AS BIGINT) AS reply_count, CAST(doc_id % 5 AS BIGINT) AS reaction_count
        FROM {documents}""",
    "comment": """
        SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 7 < 4 THEN conv_id % (SELECT count(*) FROM {documents}) END AS post_id,
          CASE WHEN conv_id % 7 IN (4, 5) AND part_id % 3 = 0 THEN owner_id * 10000000 + part_id END AS review_id, CASE WHEN conv_id % 7 IN (4, 5) AND part_id % 3 <> 0 THEN order_id END AS collection_id,
          CASE WHEN conv_id % 7 = 6 OR conv_id % 7 > 3 AND part_id IS NULL THEN conv_id % (SELECT count(*) FROM {events}) END AS activity_id,
          CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 ELSE NULL END AS parent_id, (conv_id * 3 + turn) % 100 AS author_id, (conv_id + turn) % 9 = 0 AS is_hidden, (conv_id + turn) % 23 = 5 AS is_locked, turn % 4 = 1 AS is_spoiler,
          CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS reply_count, CASE WHEN conv_id % 17 = 3 THEN 'private' ELSE 'public' END AS visibility, conv_id * 13 % 6000 + turn AS created_minute, text AS content
        FROM {conversations} CROSS JOIN (SELECT count(*) AS n FROM {orders}) o JOIN {order_item} ON order_id = conv_id % o.n""",
    "comment_activity": "SELECT id + 1000000000 AS id, author_id AS user_id, post_id, id AS comment_id, CASE WHEN id % 29 = 0 THEN 'featured' ELSE 'normal' END AS feed_policy FROM {comment}",
    "reaction": """
        SELECT id, user_id, target_type, target_id, reaction_type, created_at FROM (
          SELECT event_id AS id, user_id, ts AS created_at, CASE event_id % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'comment' ELSE 'activity' END AS target_type,
            CASE event_id % 3 WHEN 0 THEN event_id % (SELECT count(*) FROM {documents}) WHEN 1 THEN event_id % (SELECT count(DISTINCT conv_id) FROM {conversations}) * 1000 ELSE event_id * 3 % (SELECT count(*) FROM {events}) END AS target_id,
            CASE event_id % 4 WHEN 0 THEN 'useful' WHEN 1 THEN 'agree' ELSE 'like' END AS reaction_type
          FROM {events} WHERE event_type IN ('click', 'view')) x""",
    "bookmark": """
        SELECT id, user_id, created_at, CASE WHEN kind = 0 THEN number % (SELECT count(*) FROM {documents}) END AS post_id,
          CASE WHEN kind = 1 THEN (SELECT min(id) FROM {review}) END AS review_id, CASE WHEN kind = 2 THEN number % (SELECT count(*) FROM {orders}) END AS collection_id
        FROM (SELECT event_id AS id, user_id, ts AS created_at, event_id % 3 AS kind, event_id AS number FROM {events} WHERE event_type = 'view') x""",
    "order_item": "SELECT o_orderkey AS order_id, o_custkey AS owner_id, min(l_partkey) AS part_id FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey",
    "activity": """
        SELECT event_id AS id, user_id, CASE WHEN event_type = 'signup' THEN (event_id * 7 + 3) % 100 END AS target_user_id,
          CASE WHEN event_type IN ('purchase', 'view', 'error') THEN part_id END AS subject_id,
          CASE WHEN event_type IN ('purchase', 'view', 'error') THEN owner_id * 10000000 + part_id END AS mark_id,
          CASE WHEN event_type = 'error' AND part_id % 3 = 0 THEN owner_id * 10000000 + part_id END AS review_id,
          CASE WHEN event_type = 'purchase' THEN order_id END AS collection_id, CASE WHEN event_type = 'purchase' THEN order_id * 10000000 + part_id END AS item_id,
          CASE WHEN event_type = 'click' THEN event_id % (SELECT count(*) FROM {documents}) END AS post_id, CAST(NULL AS BIGINT) AS comment_id,
          CASE event_type WHEN 'purchase' THEN 'collection_item_added' WHEN 'view' THEN 'user_subject_updated' WHEN 'error' THEN 'review_created' WHEN 'click' THEN 'post_created' ELSE 'user_followed' END AS activity_type,
          CASE event_id % 10 WHEN 0 THEN 'private' WHEN 1 THEN 'followers' ELSE 'public' END AS visibility,
          CASE WHEN event_id % 13 = 0 THEN 'hidden' WHEN event_id % 17 = 0 THEN 'featured' ELSE 'normal' END AS feed_policy,
          CASE WHEN event_type = 'view' THEN '' ELSE concat(event_type, ':', CAST(event_id % 400 AS STRING)) END AS dedupe_key, ts AS created_at
        FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {orders}) o JOIN {order_item} ON order_id = event_id % o.n""",
    "outcome": """
        SELECT event_type AS task, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS entity, CASE WHEN value < 5 THEN 'failed' WHEN value < 20 THEN 'skipped' ELSE 'synced' END AS outcome, ts
        FROM {events}""",
    "name_mapping": "SELECT * FROM (VALUES ('ECONOMY', 'TV'), ('MEDIUM', 'Web'), ('SMALL', 'Novel'), ('Brand#1', 'One'), ('Brand#2', 'Two'), ('Brand#3', 'Three'), ('Brand#10', 'Ten')) AS x(external_name, internal_name)",
    "notification": """
        SELECT event_id AS id, (event_id * 5 + 1) % 100 AS recipient_id, user_id AS actor_id, CASE WHEN event_type = 'click' THEN event_id END AS activity_id, CASE WHEN event_id % 4 = 0 THEN event_id % (SELECT count(*) FROM {documents}) END AS post_id,
          CASE WHEN event_id % 4 = 1 THEN event_id END AS comment_id, CASE WHEN event_id % 4 = 2 THEN event_id END AS review_id, CASE WHEN event_id % 2 = 1 THEN event_id END AS collection_id,
          CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS read_at, ts AS created_at
        FROM {events} WHERE event_type IN ('click', 'error')""",
    "report": """
        SELECT event_id AS id, user_id AS reporter_id, CASE WHEN event_id % 2 = 0 THEN event_id % (SELECT count(*) FROM {documents}) END AS post_id, CASE WHEN event_id % 2 = 1 THEN event_id % (SELECT count(DISTINCT conv_id) FROM {conversations}) * 1000 END AS comment_id,
          CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'resolved' ELSE 'rejected' END AS status, ts AS created_at
        FROM {events} WHERE event_type = 'error'""",
    "sync_job": """
        SELECT event_id AS id, event_type AS job_type, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status, ts AS created_at FROM {events} WHERE event_id % 5 = 0""",
}


def needed(text: str, done: dict | None = None) -> dict[str, str]:
    """The views a text refers to, directly or not, each after those it needs itself."""
    done = {} if done is None else done
    for name in re.findall(r"\{(\w+)\}", text):
        if name in VIEWS and name not in done:
            needed(VIEWS[name], done)
            done[name] = VIEWS[name]
    return done


def with_views(sql: str) -> str:
    """A query for DuckDB over the synthetic tables, with the views it needs in front."""
    name = lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1]
    parts = [f"v_{k} AS ({re.sub(r'\{(\w+)\}', name, v)})" for k, v in needed(sql).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + re.sub(r"\{(\w+)\}", name, sql)


#: Shuffle partitions for each split of an input. Spark makes splits of 128 MB at most.
DEALT = 8


def at_size(table: DataFrame) -> DataFrame:
    """The table as it is; if it has several splits, its session's shuffles get DEALT partitions for each of them if they had
    fewer, so that a task's share doesn't grow with the input. Small partitions are put together again by Spark."""
    conf, splits = table.sparkSession.conf, table.rdd.getNumPartitions()
    if splits > 1 and int(conf.get("spark.sql.shuffle.partitions")) < DEALT * splits:
        conf.set("spark.sql.shuffle.partitions", str(DEALT * splits))
    return table


class Views:
    """The same views as DataFrames over one data folder, made when asked for: views.mark, views.activity, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def keep(self, *names: str) -> None:
        """Writes views once, for a query that reads them several times, and for views over them that are made from now on."""
        for name in names:
            self.made[name] = stored(getattr(self, name))

    def keep_columns(self, name: str, *columns: str, rows: DataFrame | None = None) -> None:
        """As `keep`, of the columns given; the others, which the query and its views don't read, are null. rows: those of the
        view that count, if not all do."""
        view = getattr(self, name)
        kept = stored((view if rows is None else rows).select(*columns))
        self.made[name] = kept.select(*[F.col(c) if c in columns else F.lit(None).cast(view.schema[c].dataType).alias(c) for c in view.columns])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self.made:
            if name in TABLES:
                self.made[name] = at_size(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
            else:
                text = VIEWS[name]
                rows = self.spark.sql(text, **{k: getattr(self, k) for k in set(re.findall(r"\{(\w+)\}", text))})
                # Joins with a hint keep their order. Else a filter on columns of both sides lets Spark pair all events with all
                # orders before the number of orders, which the join's key needs, is there.
                self.made[name] = rows.hint("merge") if name == "order_item" else rows
        return self.made[name]
