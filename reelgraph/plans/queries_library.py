"""Queries of the personal libraries: marks, progress, reviews, collections, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, community, library
from ..sources.shared import stored
from .queries_catalog import FOUND
from .registry import query

S = "JOIN {subject} s ON s.id = m.subject_id"
LIKES = "(SELECT target_type, target_id, count(DISTINCT user_id) AS likes FROM {reaction} WHERE reaction_type = 'like' GROUP BY 1, 2)"
LOCAL = "(SELECT m.*, CASE WHEN zone = 'America/New_York' THEN CAST(created_at AS DATE) - 1 ELSE CAST(created_at AS DATE) END AS day FROM {mark} m JOIN {profile} p ON p.user_id = m.user_id)"


def orders(rows, spec):
    """SQL: the rows once for each ordering, with their place in the user's list."""
    return " UNION ALL ".join(f"SELECT '{name}' AS sorted, id, user_id, title, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS INT) AS place FROM ({rows}) x" for name, order in spec.items())


def in_each_order(f, spec):
    return f(list(spec)).select("sorted", "id", "user_id", "title", "place")


LISTED = {"-created_at": "created_at DESC NULLS FIRST, id DESC", "updated_at": "updated_at ASC NULLS LAST, id DESC", "simple_rating": "simple_rating ASC NULLS LAST, id DESC", "-simple_rating": "simple_rating DESC NULLS FIRST, id DESC", "-rating": "rating DESC NULLS FIRST, id DESC", "email": "created_at DESC NULLS FIRST, id DESC"}


@query(orders(f"SELECT m.*, title FROM {{mark}} m {S} WHERE subject_type IN ('anime', 'galgame') AND status = 'doing' AND m.id IN (SELECT mark_id FROM {{mark_tag}} JOIN {{user_tag}} u ON u.id = tag_id WHERE name LIKE 'Brand#1%')", LISTED))
def library_list(v):
    tagged = v.mark_tag.join(v.user_tag.where("name LIKE 'Brand#1%'").select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return in_each_order(lambda o: library.library_list(v.mark, v.subject, status="doing", tagged=tagged, order=o), LISTED)


PUBLIC = {"-id": "id DESC", "id": "id", "simple_rating": "simple_rating ASC NULLS LAST, id DESC", "-simple_rating": "simple_rating DESC NULLS FIRST, id DESC", "created_at": "id DESC"}


@query(orders(f"SELECT m.*, title FROM {{mark}} m {S} WHERE is_public AND status = 'done' AND (contains(upper(title), 'RED') OR contains(upper(title_cn), 'RED') OR contains(upper(comment), 'RED'))", PUBLIC))
def public_library(v):
    return in_each_order(lambda o: library.public_library(v.mark, v.subject, "done", "red", order=o), PUBLIC)


@query(f"""SELECT m.id, m.user_id, f.title, round(f.score, 9) AS score, 'all' AS kind, CAST(row_number() OVER (PARTITION BY m.user_id ORDER BY score DESC, created_at DESC, m.id DESC) AS INT) AS place FROM {{mark}} m JOIN {FOUND} f ON f.id = m.subject_id
    UNION ALL SELECT m.id, m.user_id, f.title, round(f.score, 9), 'some', CAST(row_number() OVER (PARTITION BY m.user_id ORDER BY score DESC, created_at DESC, m.id DESC) AS INT) FROM {{mark}} m JOIN {FOUND} f ON f.id = m.subject_id JOIN {{subject}} s ON s.id = m.subject_id
    WHERE m.status = 'done' AND s.subject_type = 'anime' AND m.id IN (SELECT mark_id FROM {{mark_tag}} JOIN {{user_tag}} u ON u.id = tag_id WHERE name LIKE 'Brand#1%')""")
def library_search(v):
    tagged = v.mark_tag.join(v.user_tag.where("name LIKE 'Brand#1%'").select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    shown = lambda rows, kind: rows.select("id", "user_id", "title", F.round("score", 9).alias("score"), F.lit(kind).alias("kind"), "place")
    return shown(library.library_search(v.mark, v.subject, "red widget"), "all").unionByName(shown(library.library_search(v.mark, v.subject, "red widget", "done", "anime", tagged), "some"))


@query(f"SELECT user_id, CAST(day AS STRING) AS day, count(*) AS marks FROM {LOCAL} x WHERE day >= DATE '1997-01-01' AND day < DATE '1998-01-01' GROUP BY 1, 2")
def mark_calendar(v):
    return library.mark_calendar(v.mark, v.profile, 1997).select("user_id", F.col("day").cast("string").alias("day"), "marks")


@query(f"SELECT user_id, string_agg(CAST(y AS STRING), ',' ORDER BY y DESC) AS years FROM (SELECT DISTINCT user_id, year(day) AS y FROM {LOCAL} x) z GROUP BY 1")
def available_years(v):
    return library.available_years(v.mark, v.profile).select("user_id", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


@query(f"""SELECT p.user_id, coalesce(a.n, 0) AS marks, coalesce(b.n, 0) AS reviews, coalesce(d.n, 0) AS collections, coalesce(e.n, 0) AS marks_in_year FROM {{profile}} p
    LEFT JOIN (SELECT user_id, count(*) AS n FROM {{mark}} GROUP BY 1) a ON a.user_id = p.user_id LEFT JOIN (SELECT user_id, count(*) AS n FROM {{review}} r JOIN {{mark}} m ON m.id = r.mark_id GROUP BY 1) b ON b.user_id = p.user_id
    LEFT JOIN (SELECT user_id, count(*) AS n FROM {{collection}} GROUP BY 1) d ON d.user_id = p.user_id LEFT JOIN (SELECT user_id, count(*) AS n FROM {LOCAL} x WHERE year(day) = 1997 GROUP BY 1) e ON e.user_id = p.user_id""")
def profile_totals(v):
    return library.profile_totals(v.profile.select("user_id"), v.mark, v.review, v.collection, v.profile, 1997)


@query("""SELECT p.user_id, (SELECT count(*) FROM {mark} m WHERE m.user_id = p.user_id AND is_public) AS public_marks,
    (SELECT count(*) FROM {review} r JOIN {mark} m ON m.id = r.mark_id WHERE m.user_id = p.user_id AND m.is_public AND r.is_public) AS public_reviews, (SELECT count(*) FROM {collection} k WHERE k.user_id = p.user_id AND is_public) AS public_collections,
    (SELECT count(*) FROM {follow} f WHERE f.follower_id = p.user_id) AS following, (SELECT count(*) FROM {follow} f WHERE f.following_id = p.user_id) AS followers FROM {profile} p""")
def profile_counts(v):
    return library.profile_counts(v.profile.select("user_id"), v.mark, v.review, v.collection, v.follow)


@query("""SELECT m.id, coalesce(e.n, 0) AS total_episodes, coalesce(d.n, 0) AS finished_count, coalesce(d.ids, '') AS finished_ids FROM {mark} m LEFT JOIN (SELECT subject_id, count(*) AS n FROM {episode} WHERE type = 'EP' GROUP BY 1) e ON e.subject_id = m.subject_id
    LEFT JOIN (SELECT mark_id, count(*) AS n, string_agg(CAST(episode_id AS STRING), ',' ORDER BY sort, ep_num NULLS LAST, episode_id) AS ids FROM {progress} JOIN {episode} x ON x.id = episode_id GROUP BY 1) d ON d.mark_id = m.id""")
def progress_summary(v):
    rows = library.progress_summary(v.mark, v.episode, v.progress)
    return rows.select("id", "total_episodes", "finished_count", F.array_join(F.transform("finished_ids", lambda i: i.cast("string")), ",").alias("finished_ids"))


@query("SELECT m.id, e.id AS episode_id, g.mark_id IS NOT NULL AS is_finished, CAST(row_number() OVER (PARTITION BY m.id ORDER BY sort, ep_num NULLS LAST, e.id) AS INT) AS place FROM {mark} m JOIN {episode} e ON e.subject_id = m.subject_id AND e.type = 'EP' LEFT JOIN {progress} g ON g.mark_id = m.id AND g.episode_id = e.id")
def episode_progress(v):
    v.keep("mark")
    return library.episode_progress(v.mark, v.episode, v.progress).select("id", "episode_id", "is_finished", "place")


CARDS = """(SELECT m.id, m.user_id, m.subject_id, coalesce(t.tags, '') AS tags, coalesce(d.details, '') AS details FROM {mark} m LEFT JOIN (SELECT mark_id, string_agg(name, ',' ORDER BY name, tag_id) AS tags FROM {mark_tag} JOIN {user_tag} u ON u.id = tag_id GROUP BY 1) t ON t.mark_id = m.id
    LEFT JOIN (SELECT mark_id, string_agg(key, ',' ORDER BY id) AS details FROM {rating_detail} GROUP BY 1) d ON d.mark_id = m.id)"""


@query(f"SELECT id, tags, details FROM {CARDS} x")
def library_cards(v):
    rows = library.library_cards(v.mark.select("id"), v.mark_tag, v.user_tag, v.rating_detail)
    return rows.select("id", F.array_join("tags.name", ",").alias("tags"), F.array_join("details.key", ",").alias("details"))


@query(f"""SELECT a.user_id, a.subject_id, coalesce(x.id, -1) AS mark_id, coalesce(tags, '') AS tags, coalesce(details, '') AS details, (SELECT count(*) FROM {{review}} r WHERE r.mark_id = x.id) AS reviews, (SELECT count(*) FROM {{progress}} g WHERE g.mark_id = x.id) AS finished
    FROM (SELECT DISTINCT user_id, subject_id FROM {{activity}} WHERE subject_id IS NOT NULL) a LEFT JOIN {CARDS} x ON x.user_id = a.user_id AND x.subject_id = a.subject_id""")
def subject_context(v):
    """What is asked for and the marks that it asks for, joins of lineitem and orders, are made once; tags, details, reviews and
    progress are views of marks, and so are made of these alone."""
    asked = stored(v.activity.where("subject_id IS NOT NULL").select("user_id", "subject_id").distinct())
    v.keep_columns("mark", "id", "user_id", "subject_id", "status", rows=v.mark.join(asked, ["user_id", "subject_id"], "left_semi"))
    rows = library.subject_context(asked, v.mark, v.mark_tag, v.user_tag, v.rating_detail, v.review, v.progress)
    return rows.fillna(-1, ["mark_id"]).select("user_id", "subject_id", "mark_id", F.array_join("tags.name", ",").alias("tags"), F.array_join("details.key", ",").alias("details"), F.size("reviews").cast("long").alias("reviews"), F.size("finished").cast("long").alias("finished"))


@query("SELECT u.user_id, u.id AS tag_id, name, count(mark_id) AS uses FROM {user_tag} u LEFT JOIN {mark_tag} ON tag_id = u.id GROUP BY 1, 2, 3")
def tags_list(v):
    return library.tags_list(v.mark_tag, v.user_tag)


@query("SELECT mark_id, string_agg(concat(key, '=', CAST(CAST(value AS INT) AS STRING)), ',' ORDER BY id) AS details FROM {rating_detail} GROUP BY 1")
def rating_details(v):
    rows = library.rating_map(v.rating_detail)
    return rows.select("mark_id", F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string"))), ",").alias("details"))


MINE = {"-created_at": "created_at DESC, id DESC", "created_at": "created_at, id DESC", "-id": "id DESC", "title": "created_at DESC, id DESC"}


@query(orders("SELECT r.id, m.user_id, title, r.created_at FROM {review} r JOIN {mark} m ON m.id = r.mark_id WHERE contains(upper(title), 'DONE') OR contains(upper(content), 'DONE')", MINE))
def my_reviews(v):
    return in_each_order(lambda o: library.reviews_list(v.review, v.mark, "done", order=o), MINE)


THEIRS = {"-id": "id DESC", "-created_at": "created_at DESC, id DESC", "title": "id DESC"}


@query(orders("SELECT r.id, m.user_id, title, r.created_at FROM {review} r JOIN {mark} m ON m.id = r.mark_id WHERE r.is_public AND m.is_public AND (contains(upper(title), 'WISH') OR contains(upper(content), 'WISH'))", THEIRS))
def public_reviews(v):
    return in_each_order(lambda o: library.reviews_list(v.review, v.mark, "wish", public=True, order=o), THEIRS)


HIDES = "(SELECT user_id AS viewer_id, target_id AS author_id FROM {block} UNION SELECT target_id, user_id FROM {block})"


@query(f"""SELECT a.viewer_id, r.id, m.subject_id, 0 AS likes, CAST(row_number() OVER (PARTITION BY a.viewer_id, m.subject_id ORDER BY r.updated_at DESC, r.id DESC) AS INT) AS place FROM {{review}} r JOIN {{mark}} m ON m.id = r.mark_id JOIN (SELECT DISTINCT user_id AS viewer_id, subject_id FROM {{activity}} WHERE subject_id IS NOT NULL) a ON a.subject_id = m.subject_id
    WHERE r.is_public AND m.is_public AND NOT EXISTS (SELECT 1 FROM {HIDES} h WHERE h.viewer_id = a.viewer_id AND h.author_id = m.user_id)""")
def subject_reviews(v):
    viewers = v.activity.where("subject_id IS NOT NULL").select(F.col("user_id").alias("viewer_id"), "subject_id").distinct()
    rows = library.subject_reviews(v.review, v.mark, viewers, v.block, community.like_counts(v.reaction))
    return rows.select("viewer_id", "id", "subject_id", F.col("likes").cast("int").alias("likes"), "place")


COUNTED = f"(SELECT k.*, (SELECT count(*) FROM {{item}} i WHERE i.collection_id = k.id) AS item_count, coalesce(likes, 0) AS reaction_count FROM {{collection}} k LEFT JOIN {LIKES} l ON l.target_type = 'activity' AND l.target_id = k.id)"


@query(f"SELECT id, item_count, reaction_count FROM {COUNTED} x")
def collection_counts(v):
    likes = community.like_counts(v.reaction).where("target_type = 'activity'").withColumn("target_type", F.lit("collection"))
    return library.collection_counts(v.collection, v.item, likes).select("id", "item_count", "reaction_count")


NAMED = {"item_count": "item_count, id DESC", "-item_count": "item_count DESC, id DESC", "name": "title, id DESC", "-name": "title DESC, id DESC", "id": "id", "random": "id"}


@query(orders(f"SELECT id, user_id, name AS title, item_count FROM {COUNTED} k WHERE contains(upper(name), 'LOW')", NAMED) + f" UNION ALL SELECT 'public', id, user_id, name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS INT) FROM {COUNTED} x WHERE is_public AND (contains(upper(name), 'ORDER O') OR contains(upper(note), 'ORDER O'))")
def collections_list(v):
    counted = library.collection_counts(v.collection, v.item, community.like_counts(v.reaction))
    own = in_each_order(lambda o: library.collections_list(counted, "low", order=o).withColumnRenamed("name", "title"), NAMED)
    return own.unionByName(library.collections_list(counted, "order o", public=True).select(F.lit("public").alias("sorted"), "id", "user_id", F.col("name").alias("title"), "place"))


@query("SELECT i.id, collection_id, title, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY place, i.id) AS INT) AS position FROM {item} i JOIN {mark} m ON m.id = i.mark_id JOIN {subject} s ON s.id = m.subject_id WHERE is_public")
def collection_items(v):
    return library.collection_items(v.item, v.mark, v.subject, public=True).select("id", "collection_id", "title", "position")


@query("""SELECT m.id AS mark_id, e.episode_id, CASE WHEN k > 1 THEN 'repeated' ELSE 'unknown' END AS problem FROM {mark} m JOIN (SELECT mark_id, episode_id, count(*) AS k FROM {progress} GROUP BY 1, 2) e ON e.mark_id = m.id
    LEFT JOIN {episode} x ON x.id = e.episode_id AND x.type = 'EP' AND x.subject_id = m.subject_id WHERE x.id IS NULL""")
def invalid_members(v):
    v.keep("mark")
    marks, episodes = v.mark.select(F.col("id").alias("mark_id"), "subject_id"), v.episode.where("type = 'EP'").select(F.col("id").alias("episode_id"), "subject_id")
    return audit.invalid_members(v.progress.select("mark_id", "episode_id"), marks, episodes, "mark_id", "episode_id", "subject_id")


@query("SELECT parent, child, CAST(row_number() OVER (PARTITION BY parent ORDER BY first, child) - 1 AS INT) AS place FROM (SELECT l_orderkey AS parent, l_partkey AS child, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) x")
def dedupe_ordered(v):
    return audit.dedupe_ordered(v.lineitem, "l_orderkey", "l_partkey", "l_linenumber").withColumnRenamed("l_orderkey", "parent").withColumnRenamed("l_partkey", "child")
