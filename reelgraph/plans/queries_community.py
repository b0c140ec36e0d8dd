"""Queries of the community: edges, feeds, targets, counters, derived tables, moderation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as c
from ..operators import derive as d
from ..operators import edges as e
from ..operators import ingest as g
from ..operators import moderation as m
from ..operators import threads as th
from ..sources.shared import stored
from .registry import query

BLOCKED = "(SELECT user_id AS viewer_id, target_id AS author_id FROM {block} UNION SELECT target_id, user_id FROM {block})"
HIDDEN = "(SELECT user_id AS viewer_id, target_id AS author_id FROM {block} UNION SELECT target_id, user_id FROM {block} UNION SELECT user_id, target_id FROM {mute})"
VISIBLE = """(SELECT a.* FROM {activity} a LEFT JOIN {mark} m ON m.id = a.mark_id LEFT JOIN {review} r ON r.id = a.review_id LEFT JOIN {mark} rm ON rm.id = r.mark_id LEFT JOIN {collection} k ON k.id = a.collection_id
    LEFT JOIN {item} i ON i.id = a.item_id LEFT JOIN {collection} ik ON ik.id = i.collection_id LEFT JOIN {mark} im ON im.id = i.mark_id
    WHERE a.visibility = 'public' AND a.feed_policy <> 'hidden' AND coalesce(m.is_public, TRUE) AND coalesce(r.is_public, TRUE) AND coalesce(rm.is_public, TRUE) AND coalesce(k.is_public, TRUE) AND coalesce(ik.is_public, TRUE) AND coalesce(im.is_public, TRUE))"""
EDGES = f"(SELECT follower_id AS viewer_id, following_id AS author_id FROM {{follow}} f WHERE NOT EXISTS (SELECT 1 FROM {HIDDEN} h WHERE h.viewer_id = follower_id AND h.author_id = following_id) UNION SELECT user_id, user_id FROM {{profile}})"
LIKES = "(SELECT target_type, target_id, count(DISTINCT user_id) AS likes FROM {reaction} WHERE reaction_type = 'like' GROUP BY 1, 2)"
OWNERS = """(SELECT 'post' AS target_type, id AS target_id, author_id AS owner_id FROM {post} UNION ALL SELECT 'comment', id, author_id FROM {comment} UNION ALL SELECT 'review', r.id, m.user_id FROM {review} r JOIN {mark} m ON m.id = r.mark_id
    UNION ALL SELECT 'collection', id, user_id FROM {collection} UNION ALL SELECT 'activity', id, user_id FROM {activity})"""
FIRST_REACTION = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target_type, target_id, reaction_type ORDER BY created_at, id) AS n FROM {reaction}) x WHERE n = 1)"


def visible(v):
    return c.visible_activities(v.activity, v.mark, v.review, v.collection, v.item)


def edges(v):
    return c.following_edges(v.follow, v.block, v.mute, v.profile)


def text(*columns):
    return [F.col(x).cast("string").alias(x) for x in columns]


@query(f"SELECT viewer_id, author_id FROM {HIDDEN} x")
def viewer_edges(v):
    return e.hidden_authors(v.block, v.mute)


@query(f"SELECT a, b, EXISTS (SELECT 1 FROM {BLOCKED} h WHERE h.viewer_id = a AND h.author_id = b) AS blocked FROM (SELECT follower_id AS a, following_id AS b FROM {{follow}}) x")
def blocked_between(v):
    return e.blocked_between(v.follow.select(F.col("follower_id").alias("a"), F.col("following_id").alias("b")), v.block)


@query(f"SELECT viewer_id, author_id FROM (SELECT DISTINCT user_id AS viewer_id, id % 100 AS author_id FROM {{activity}}) x WHERE NOT EXISTS (SELECT 1 FROM {BLOCKED} h WHERE h.viewer_id = x.viewer_id AND h.author_id = x.author_id)")
def profile_gate(v):
    return e.profile_gate(v.activity.select(F.col("user_id").alias("viewer_id"), (F.col("id") % 100).alias("author_id")).distinct(), v.block)


@query(f"SELECT 'follow' AS kind, follower_id AS a, following_id AS b FROM {{follow}} WHERE NOT EXISTS (SELECT 1 FROM {BLOCKED} h WHERE viewer_id = follower_id AND author_id = following_id) UNION ALL SELECT 'mute', user_id, target_id FROM {{mute}} m WHERE NOT EXISTS (SELECT 1 FROM {{block}} b WHERE b.user_id = m.user_id AND b.target_id = m.target_id)")
def edge_purge(v):
    follows, mutes = e.edge_purge(v.follow, v.mute, v.block)
    return follows.select(F.lit("follow").alias("kind"), F.col("follower_id").alias("a"), F.col("following_id").alias("b")).unionByName(mutes.select(F.lit("mute").alias("kind"), F.col("user_id").alias("a"), F.col("target_id").alias("b")))


@query("""SELECT 'following' AS kind, follower_id AS user_id, following_id AS other_id, nickname, CAST(row_number() OVER (PARTITION BY follower_id ORDER BY created_at DESC, following_id DESC) AS INT) AS place FROM {follow} JOIN {profile} p ON p.user_id = following_id
    UNION ALL SELECT 'follower', following_id, follower_id, nickname, CAST(row_number() OVER (PARTITION BY following_id ORDER BY created_at DESC, follower_id DESC) AS INT) FROM {follow} JOIN {profile} p ON p.user_id = follower_id""")
def follow_lists(v):
    return e.follow_lists(v.follow, v.profile).select("kind", "user_id", "other_id", "nickname", "place")


@query("SELECT kind, x.user_id, target_id AS other_id, coalesce(nickname, '') AS nickname, CAST(row_number() OVER (PARTITION BY kind, x.user_id ORDER BY created_at DESC, target_id DESC) AS INT) AS place FROM (SELECT 'block' AS kind, user_id, target_id, created_at FROM {block} UNION ALL SELECT 'mute', user_id, target_id, created_at FROM {mute}) x LEFT JOIN {profile} p ON p.user_id = target_id")
def block_mute_lists(v):
    return e.block_mute_lists(v.block, v.mute, v.profile).select("kind", "user_id", "other_id", "nickname", "place")


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS following_count, coalesce(b.n, 0) AS follower_count FROM (SELECT follower_id AS user_id, count(*) AS n FROM {follow} GROUP BY 1) a FULL JOIN (SELECT following_id AS user_id, count(*) AS n FROM {follow} GROUP BY 1) b ON a.user_id = b.user_id")
def follow_stats(v):
    return e.follow_stats(v.follow)


@query(f"SELECT id, user_id, activity_type FROM {VISIBLE} x")
def activity_public(v):
    return visible(v).select("id", "user_id", "activity_type")


#: Tables as they were: every seventh mark and fifth collection had its flag turned, every third activity was hidden.
BEFORE = {"mark": ("is_public", "id % 7 = 0", "NOT is_public"), "collection": ("is_public", "id % 5 = 0", "NOT is_public"), "activity": ("feed_policy", "id % 3 = 0", "'hidden'")}
#: What visibility follows from, and what it is read by.
DECIDING = {"activity": ("id", "visibility", "feed_policy", "mark_id", "review_id", "collection_id", "item_id"), "mark": ("id", "is_public"), "review": ("id", "mark_id", "is_public"), "collection": ("id", "is_public"), "item": ("id", "collection_id", "mark_id")}


@query(f"SELECT id FROM {VISIBLE} x")
def activity_public_delta(v):
    """The visible ids before some rows changed, brought up to date by the changes alone. The views are joins of lineitem and
    orders and are read many times: each is made once, of the columns that count here."""
    tables = {k: stored(getattr(v, k).select(*columns)) for k, columns in DECIDING.items()}
    old = {k: rows.withColumn(BEFORE[k][0], F.expr(f"CASE WHEN {BEFORE[k][1]} THEN {BEFORE[k][2]} ELSE {BEFORE[k][0]} END")) if k in BEFORE else rows for k, rows in tables.items()}
    seen = stored(c.visible_among(*old.values()).select("id"))
    changed = {k: tables[k].where(where).select("id") for k, (_, where, _) in BEFORE.items()}
    return c.with_changes(seen, stored(c.visible_changes(seen, tables["activity"], changed, tables["mark"], tables["review"], tables["collection"], tables["item"])))


@query(f"SELECT viewer_id, a.id, a.user_id AS author_id FROM {EDGES} e JOIN {VISIBLE} a ON a.user_id = author_id")
def following_feed(v):
    return c.following_feed(visible(v), edges(v)).select("viewer_id", "id", "author_id")


@query(f"SELECT viewer_id, rank, id, coalesce(likes, 0) AS likes FROM (SELECT viewer_id, a.id, CAST(row_number() OVER (PARTITION BY viewer_id ORDER BY created_at DESC, a.id DESC) AS INT) AS rank FROM {EDGES} e JOIN {VISIBLE} a ON a.user_id = author_id) x LEFT JOIN {LIKES} l ON l.target_type = 'activity' AND l.target_id = id WHERE rank <= 16")
def feed_top_k(v):
    likes = c.like_counts(v.reaction).where("target_type = 'activity'").select(F.col("target_id").alias("id"), "likes")
    return c.feed_top_k(visible(v), edges(v)).join(likes, "id", "left").fillna(0, ["likes"]).select("viewer_id", "rank", "id", "likes")


@query(f"SELECT viewer_id, id, rank FROM (SELECT p.user_id AS viewer_id, a.id, CAST(row_number() OVER (PARTITION BY p.user_id ORDER BY created_at DESC, a.id DESC) AS INT) AS rank FROM {{profile}} p CROSS JOIN {VISIBLE} a WHERE NOT EXISTS (SELECT 1 FROM {HIDDEN} h WHERE h.viewer_id = p.user_id AND h.author_id = a.user_id)) x WHERE rank <= 16")
def global_feed(v):
    viewers = v.profile.select(F.col("user_id").alias("viewer_id"))
    return c.global_feed(visible(v), viewers, e.hidden_authors(v.block, v.mute)).select("viewer_id", "id", "rank")


OWN = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY {0}) AS INT) AS place"


@query(f"""SELECT user_id, id, 'own' AS kind, {OWN.format('created_at DESC, id DESC')} FROM {{activity}} WHERE activity_type = 'post_created' UNION ALL SELECT user_id, id, 'public', {OWN.format('created_at DESC, id DESC')} FROM {VISIBLE} x WHERE activity_type = 'post_created'
    UNION ALL SELECT user_id, id, 'by id', {OWN.format('id')} FROM {{activity}} WHERE activity_type = 'post_created'""")
def user_activities(v):
    own = c.user_activities(v.activity, activity_type="post_created").select("user_id", "id", F.lit("own").alias("kind"), "place")
    by_id = c.user_activities(v.activity, activity_type="post_created", order="id").select("user_id", "id", F.lit("by id").alias("kind"), "place")
    return own.unionByName(c.user_activities(v.activity, visible(v), "post_created", "unknown").select("user_id", "id", F.lit("public").alias("kind"), "place")).unionByName(by_id)


POSTS = {"-last_activity_at": "last_activity_minute DESC NULLS LAST, id DESC", "last_activity_at": "last_activity_minute ASC NULLS LAST, id DESC", "-created_at": "created_minute DESC, id DESC", "reply_count": "reply_count, id DESC", "-reaction_count": "reaction_count DESC, id DESC", "author": "last_activity_minute DESC NULLS LAST, id DESC"}
SHOWN = f"(SELECT w.viewer_id, p.* FROM (SELECT DISTINCT user_id AS viewer_id, subject_id FROM {{activity}} WHERE subject_id IS NOT NULL) w JOIN {{post}} p ON p.subject_id = w.subject_id WHERE p.visibility = 'public' AND p.feed_policy <> 'hidden' AND contains(upper(content), 'TH') AND NOT EXISTS (SELECT 1 FROM {HIDDEN} h WHERE h.viewer_id = w.viewer_id AND h.author_id = p.author_id))"


@query(" UNION ALL ".join(f"SELECT '{name}' AS sorted, viewer_id, id, author_id, CAST(row_number() OVER (PARTITION BY viewer_id ORDER BY {order}) AS INT) AS place FROM {SHOWN} x" for name, order in POSTS.items()))
def posts_public(v):
    viewers = v.activity.where("subject_id IS NOT NULL").select(F.col("user_id").alias("viewer_id"), "subject_id").distinct()
    posts = v.post.withColumnsRenamed({"last_activity_minute": "last_activity_at", "created_minute": "created_at"})
    return c.posts_list(posts, viewers, e.hidden_authors(v.block, v.mute), keyword="th", order=list(POSTS)).select("sorted", "viewer_id", "id", "author_id", "place")


@query(f"SELECT viewer_id, k.id, CASE WHEN is_hidden THEN -1 ELSE k.author_id END AS shown_author, CAST(row_number() OVER (PARTITION BY viewer_id, w.post_id ORDER BY created_minute, k.id) AS INT) AS place FROM (SELECT DISTINCT user_id AS viewer_id, post_id FROM {{activity}} WHERE post_id IS NOT NULL) w JOIN {{comment}} k ON k.post_id = w.post_id WHERE k.visibility = 'public' AND (NOT is_hidden OR reply_count > 0) AND NOT EXISTS (SELECT 1 FROM {HIDDEN} h WHERE h.viewer_id = w.viewer_id AND h.author_id = k.author_id)")
def comments_public(v):
    viewers = v.activity.where("post_id IS NOT NULL").select(F.col("user_id").alias("viewer_id"), "post_id").distinct()
    rows = c.comments_list(v.comment.withColumnRenamed("created_minute", "created_at"), viewers, e.hidden_authors(v.block, v.mute), "post_id")
    return rows.fillna(-1, ["shown_author"]).select("viewer_id", "id", "shown_author", "place")


@query("""SELECT w.viewer_id, w.post_id, EXISTS (SELECT 1 FROM {reaction} r WHERE r.user_id = viewer_id AND r.target_type = 'post' AND r.target_id = w.post_id AND r.reaction_type = 'like') AS has_liked, EXISTS (SELECT 1 FROM {bookmark} b WHERE b.user_id = viewer_id AND b.post_id = w.post_id) AS has_bookmarked,
    EXISTS (SELECT 1 FROM {follow} f WHERE f.follower_id = viewer_id AND f.following_id = author_id) AS is_following FROM (SELECT DISTINCT user_id AS viewer_id, post_id FROM {activity} WHERE post_id IS NOT NULL) w JOIN {post} p ON p.id = w.post_id""")
def viewer_state(v):
    shown = v.activity.where("post_id IS NOT NULL").select(F.col("user_id").alias("viewer_id"), "post_id").distinct().join(v.post.select(F.col("id").alias("post_id"), "author_id"), "post_id")
    shown = shown.select("viewer_id", F.lit("post").alias("target_type"), F.col("post_id").alias("target_id"), "author_id")
    return c.viewer_state(shown, v.reaction, v.bookmark, v.follow).select("viewer_id", F.col("target_id").alias("post_id"), "has_liked", "has_bookmarked", "is_following")


@query(f"""SELECT 'post' AS target_type, id AS target_id, author_id AS owner_id FROM {{post}} WHERE visibility = 'public' AND feed_policy <> 'hidden'
    UNION ALL SELECT 'comment', id, author_id FROM {{comment}} WHERE NOT is_hidden AND visibility = 'public'
    UNION ALL SELECT 'review', r.id, m.user_id FROM {{review}} r JOIN {{mark}} m ON m.id = r.mark_id WHERE r.is_public AND m.is_public UNION ALL SELECT 'collection', id, user_id FROM {{collection}} WHERE is_public UNION ALL SELECT 'activity', id, user_id FROM {VISIBLE} x""")
def target_public(v):
    return c.public_targets(v.post, v.comment, v.review, v.mark, v.collection, visible(v))


@query(f"SELECT r.id, r.target_type, r.target_id, owner_id FROM {{reaction}} r JOIN {OWNERS} o ON o.target_type = r.target_type AND o.target_id = r.target_id")
def target_owner(v):
    return v.reaction.join(c.target_owners(v.post, v.comment, v.review, v.mark, v.collection, v.activity), ["target_type", "target_id"]).select("id", "target_type", "target_id", "owner_id")


@query("SELECT id, CASE WHEN post_id IS NOT NULL THEN 'post' WHEN review_id IS NOT NULL THEN 'review' ELSE 'collection' END AS target_type, coalesce(post_id, review_id, collection_id) AS target_id FROM {bookmark}")
def target_resolve(v):
    return c.targets(v.bookmark).select("id", "target_type", "target_id")


@query("SELECT id, CASE WHEN activity_id IS NOT NULL THEN 'activity' WHEN post_id IS NOT NULL THEN 'post' WHEN comment_id IS NOT NULL THEN 'comment' WHEN review_id IS NOT NULL THEN 'review' WHEN collection_id IS NOT NULL THEN 'collection' END AS target_type, coalesce(activity_id, post_id, comment_id, review_id, collection_id) AS target_id FROM {notification}")
def notification_target(v):
    return c.targets(v.notification, c.NOTIFIED).select("id", "target_type", "target_id")


BOOKMARKED = """(SELECT b.id, b.user_id, b.created_at, CASE WHEN b.post_id IS NOT NULL THEN 'post' WHEN b.review_id IS NOT NULL THEN 'review' ELSE 'collection' END AS target_type, CASE WHEN b.post_id IS NOT NULL THEN substr(split_part(p.content, chr(10), 1), 1, 96) WHEN b.review_id IS NOT NULL THEN r.title ELSE k.name END AS title, CASE WHEN b.post_id IS NOT NULL THEN p.content WHEN b.review_id IS NOT NULL THEN substr(r.content, 1, 240) ELSE substr(k.note, 1, 240) END AS body,
    CASE WHEN b.post_id IS NOT NULL THEN concat_ws(chr(1), p.content, s.title, s.title_cn) WHEN b.review_id IS NOT NULL THEN concat_ws(chr(1), r.title, r.content, q.title, q.title_cn) ELSE concat_ws(chr(1), k.name, k.note) END AS searched FROM {bookmark} b LEFT JOIN {post} p ON p.id = b.post_id LEFT JOIN {subject} s ON s.id = p.subject_id LEFT JOIN {review} r ON r.id = b.review_id LEFT JOIN {mark} m ON m.id = r.mark_id LEFT JOIN {subject} q ON q.id = m.subject_id LEFT JOIN {collection} k ON k.id = b.collection_id)"""


@query(f"SELECT 'all' AS kind, id, user_id, title, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INT) AS place FROM {BOOKMARKED} x WHERE contains(upper(searched), 'RED') UNION ALL SELECT 'collection', id, user_id, title, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INT) FROM {BOOKMARKED} y WHERE target_type = 'collection'")
def bookmarks_list(v):
    listed = lambda **k: c.bookmarks_list(v.bookmark, v.post, v.review, v.collection, v.mark, v.subject, **k)
    every = listed(keyword="red").select(F.lit("all").alias("kind"), "id", "user_id", "title", "place")
    return every.unionByName(listed(target_type="collection").select(F.lit("collection").alias("kind"), "id", "user_id", "title", "place"))


@query(f"SELECT id, title, length(body) AS n FROM {BOOKMARKED} x")
def bookmark_preview(v):
    return c.bookmarks_list(v.bookmark, v.post, v.review, v.collection, v.mark, v.subject).select("id", "title", F.length("body").cast("long").alias("n"))


@query("SELECT a.id, coalesce(a.subject_id, m.subject_id, im.subject_id, rm.subject_id, p.subject_id, -1) AS card_subject, s.title AS subject_title FROM {activity} a LEFT JOIN {mark} m ON m.id = a.mark_id LEFT JOIN {item} i ON i.id = a.item_id LEFT JOIN {mark} im ON im.id = i.mark_id LEFT JOIN {review} r ON r.id = a.review_id LEFT JOIN {mark} rm ON rm.id = r.mark_id LEFT JOIN {post} p ON p.id = a.post_id LEFT JOIN {subject} s ON s.id = coalesce(a.subject_id, m.subject_id, im.subject_id, rm.subject_id, p.subject_id)")
def activity_cards(v):
    return c.activity_cards(v.activity, v.mark, v.item, v.review, v.post, v.subject).fillna(-1, ["card_subject"]).select("id", "card_subject", "subject_title")


@query(f"SELECT target_type, target_id, likes FROM {LIKES} x")
def like_counts(v):
    return c.like_counts(v.reaction)


@query("SELECT user_id, target_type, target_id, reaction_type, id FROM " + FIRST_REACTION + " y")
def first_per_key(v):
    return c.first_per_key(v.reaction, ["user_id", "target_type", "target_id", "reaction_type"]).select("user_id", "target_type", "target_id", "reaction_type", "id")


@query("SELECT user_id, target_type, max(id) AS id FROM {reaction} GROUP BY 1, 2")
def latest_per_key(v):
    return c.latest_per_key(v.reaction, ["user_id", "target_type"], ("id",)).select("user_id", "target_type", "id")


@query("SELECT p.id, reaction_count AS stored, coalesce(n, 0) AS counted, reaction_count - coalesce(n, 0) AS drift FROM {post} p LEFT JOIN (SELECT target_id, count(*) AS n FROM " + FIRST_REACTION + " y WHERE target_type = 'post' GROUP BY 1) r ON r.target_id = p.id")
def recount_reactions(v):
    return c.recount_reactions(v.post, c.first_per_key(v.reaction, ["user_id", "target_type", "target_id", "reaction_type"]), "post")


@query("""SELECT 'post' AS kind, p.id, reply_count AS stored, coalesce(n, 0) AS counted, reply_count - coalesce(n, 0) AS drift FROM {post} p LEFT JOIN (SELECT post_id, count(*) AS n FROM {comment} GROUP BY 1) k ON k.post_id = p.id
    UNION ALL SELECT 'comment', p.id, reply_count, coalesce(n, 0), reply_count - coalesce(n, 0) FROM {comment} p LEFT JOIN (SELECT parent_id, count(*) AS n FROM {comment} WHERE parent_id IS NOT NULL GROUP BY 1) k ON k.parent_id = p.id""")
def recount_replies(v):
    return c.recount_replies(v.post, v.comment)


@query("SELECT p.id, greatest(p.created_minute, k.m) AS last FROM {post} p LEFT JOIN (SELECT post_id, max(created_minute) AS m FROM {comment} GROUP BY 1) k ON k.post_id = p.id")
def last_activity(v):
    return c.last_activity(v.post, v.comment)


@query("SELECT recipient_id, count(*) FILTER (WHERE read_at IS NULL) AS unread FROM {notification} GROUP BY 1")
def unread_counts(v):
    return c.unread_counts(v.notification)


@query("SELECT id, recipient_id, CAST(row_number() OVER (PARTITION BY recipient_id ORDER BY created_at DESC, id DESC) AS INT) AS place FROM {notification} WHERE read_at IS NULL")
def notifications_list(v):

    return c.notifications_list(v.notification, False).select("id", "recipient_id", "place")


@query("SELECT id, CAST(CASE WHEN recipient_id < 50 AND read_at IS NULL THEN TIMESTAMP '2025-01-01 00:00:00' ELSE read_at END AS STRING) AS read_at FROM {notification}")
def mark_all_read(v):
    return d.mark_all_read(v.notification, v.notification.where("recipient_id < 50"), F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")).select("id", *text("read_at"))


@query("SELECT 'staff' AS list, id, reporter_id, status, -1 AS place FROM {report} WHERE status = 'pending' UNION ALL SELECT 'own', id, reporter_id, status, CAST(row_number() OVER (PARTITION BY reporter_id ORDER BY created_at DESC, id DESC) AS INT) FROM {report}")
def reports_queue(v):
    staff = c.reports_list(v.report, "pending").select(F.lit("staff").alias("list"), "id", "reporter_id", "status", F.lit(-1).alias("place"))
    return staff.unionByName(c.reports_list(v.report, by_reporter=True).select(F.lit("own").alias("list"), "id", "reporter_id", "status", "place"))


@query("SELECT id, job_type, status, CAST(row_number() OVER (PARTITION BY status ORDER BY created_at DESC, id DESC) AS INT) AS place FROM {sync_job} WHERE job_type = 'view'")
def sync_jobs_list(v):
    return g.sync_jobs_list(v.sync_job, job_type="view").select("id", "job_type", "status", "place")


M = "JOIN {mark} m ON m.id ="


SNAPSHOT = """struct_pack(id := CAST(s.id AS VARCHAR), subject_type := s.subject_type, title := s.title, title_cn := s.title_cn, date := CAST(s.date AS VARCHAR), image_thumbnail := NULL, platform := s.platform, nsfw := s.nsfw)"""
OF_MARK = "struct_pack(id := m.id, status := m.status, simple_rating := m.simple_rating, rating := CASE WHEN m.rating IS NOT NULL THEN printf('%.1f', m.rating) END, comment := m.comment, is_public := m.is_public)"
BOTH = f"subject := {SNAPSHOT}, user_subject := {OF_MARK}"
JSON = "CAST(to_json(struct_pack({0})) AS VARCHAR)"
S = "JOIN {subject} s ON s.id = m.subject_id"
SEEN = "CASE WHEN {0} THEN 'public' ELSE 'private' END"
ID = "CAST({0} AS STRING)"


def act(kind, user, source, subject, message, seen, group, key, metadata, rows):
    return f"""SELECT '{kind}' AS activity_type, {user} AS user_id, {source} AS source_id, coalesce({subject}, -1) AS subject_id, {message} AS message, {seen} AS visibility, 'normal' AS feed_policy, {group} AS group_key, {key} AS dedupe_key, {JSON.format(metadata)} AS metadata FROM {rows}"""


ACTS = [
    act("user_subject_created", "m.user_id", "m.id", "m.subject_id", "concat('Added ''', s.title, ''' to collection')", SEEN.format("m.is_public"), f"concat('user_subject:', {ID.format('m.user_id')}, ':', {ID.format('m.subject_id')})", f"concat('user_subject_created:', {ID.format('m.id')})", BOTH, f"{{mark}} m {S}"),
    act("user_subject_updated", "m.user_id", "m.id", "m.subject_id", "concat('Updated collection status for ''', s.title, '''')", SEEN.format("m.is_public"), f"concat('user_subject:', {ID.format('m.user_id')}, ':', {ID.format('m.subject_id')})", "''", BOTH, f"(SELECT * FROM {{mark}} WHERE id % 4 = 1) m {S}"),
    act("review_created", "m.user_id", "r.id", "m.subject_id", "concat('Posted a review for ''', s.title, ''': ', r.title)", SEEN.format("r.is_public AND m.is_public"), f"concat('review:', {ID.format('m.subject_id')})", f"concat('review_created:', {ID.format('r.id')})", BOTH + ", review := struct_pack(id := r.id, title := r.title)", f"{{review}} r {M} r.mark_id {S}"),
    act("collection_created", "k.user_id", "k.id", "NULL", "concat('Created collection ''', k.name, '''')", SEEN.format("k.is_public"), f"concat('collection:', {ID.format('k.user_id')})", f"concat('collection_created:', {ID.format('k.id')})", "collection := struct_pack(id := k.id, name := k.name, simple_rating := NULL, note := k.note)", "{collection} k"),
    act("collection_item_added", "k.user_id", "i.id", "m.subject_id", "concat('Added ''', s.title, ''' to collection ''', k.name, '''')", SEEN.format("k.is_public AND m.is_public"), f"concat('collection:', {ID.format('k.id')})", f"concat('collection_item_added:', {ID.format('i.id')})", BOTH + ', collection := struct_pack(id := k.id, name := k.name), collection_item := struct_pack(id := i.id, relation := NULL, "order" := i.place)', f"{{item}} i {M} i.mark_id {S} JOIN {{collection}} k ON k.id = i.collection_id"),
    act("post_created", "author_id", "id", "subject_id", "'Posted a status'", "visibility", f"concat('post:', {ID.format('author_id')})", f"concat('post_created:', {ID.format('id')})", "post := struct_pack(id := id, subject_id := CAST(subject_id AS VARCHAR))", "{post}"),
    act("comment_created", "author_id", "id", "NULL", "concat('Commented on a ', kind)", "visibility", "concat(kind, '_comment:', CAST(target AS STRING))", f"concat('comment_created:', {ID.format('id')})", "target := struct_pack(type := kind, id := target), comment := struct_pack(id := id)",
        "(SELECT *, coalesce(post_id, review_id, collection_id, activity_id) AS target, CASE WHEN post_id IS NOT NULL THEN 'post' WHEN review_id IS NOT NULL THEN 'review' WHEN collection_id IS NOT NULL THEN 'collection' ELSE 'activity' END AS kind FROM {comment}) k"),
    act("user_followed", "follower_id", "-1", "NULL", "'Followed a user'", "'public'", f"concat('follow:', {ID.format('follower_id')})", f"concat('user_followed:', {ID.format('follower_id')}, ':', {ID.format('following_id')})", "target_user := struct_pack(id := following_id)", "{follow}"),
]


@query(" UNION ALL ".join(ACTS))
def derive_activities(v):
    """Marks and comments, joins of lineitem and orders, are made once, and what they shuffle is gone before the activities' own
    shuffles."""
    v.keep_columns("mark", "id", "user_id", "subject_id", *d.MARK_FIELDS)
    v.keep_columns("comment", "id", "author_id", "visibility", *[f"{kind}_id" for kind in d.COMMENTED])
    rows = d.derive_activities(v.mark, v.review, v.collection, v.item, v.post, v.comment, v.follow, v.subject, v.mark.where("id % 4 = 1").select("id"))
    return rows.fillna(-1, ["source_id", "subject_id"])


@query(f"SELECT m.id, {JSON.format(BOTH)} AS metadata FROM {{mark}} m {S}")
def activity_metadata(v):
    return d.activity_metadata(v.mark, v.subject)


@query("""SELECT id, dedupe_key FROM {activity} WHERE dedupe_key = '' UNION ALL SELECT id, dedupe_key FROM (SELECT id, dedupe_key, row_number() OVER (PARTITION BY dedupe_key ORDER BY CASE WHEN activity_type = 'user_followed' THEN -id ELSE id END) AS n FROM {activity} WHERE dedupe_key <> '') x WHERE n = 1""")
def activity_dedupe(v):
    return d.activity_dedupe(v.activity).select("id", "dedupe_key")


@query("SELECT id FROM {activity} a WHERE activity_type <> 'user_followed' OR EXISTS (SELECT 1 FROM {follow} f WHERE f.follower_id = a.user_id AND f.following_id = a.target_user_id)")
def unfollow_cleanup(v):
    return d.unfollow_cleanup(v.activity, v.follow).select("id")


@query(f"SELECT DISTINCT viewer_id, id FROM (SELECT viewer_id, a.id FROM {EDGES} e JOIN {VISIBLE} a ON a.user_id = author_id UNION SELECT user_id, id FROM {VISIBLE} b WHERE EXISTS (SELECT 1 FROM {{profile}} p WHERE p.user_id = b.user_id)) x")
def feed_self_union(v):
    return c.following_feed(visible(v), c.following_edges(v.follow, v.block, v.mute, v.profile)).select("viewer_id", "id")


@query(f"""SELECT * FROM (SELECT 'commented' AS kind, coalesce(q.author_id, p.author_id, rm.user_id, o.user_id, a.user_id) AS recipient_id, k.author_id AS actor_id, k.id AS source_id FROM {{comment}} k LEFT JOIN {{comment}} q ON q.id = k.parent_id LEFT JOIN {{post}} p ON p.id = k.post_id
      LEFT JOIN {{review}} r ON r.id = k.review_id LEFT JOIN {{mark}} rm ON rm.id = r.mark_id LEFT JOIN {{collection}} o ON o.id = k.collection_id LEFT JOIN {{activity}} a ON a.id = k.activity_id
    UNION ALL SELECT 'reacted', owner_id, r.user_id, r.id FROM {FIRST_REACTION} r JOIN {OWNERS} o ON o.target_type = r.target_type AND o.target_id = r.target_id UNION ALL SELECT 'followed', following_id, follower_id, -1 FROM {{follow}}) x WHERE recipient_id IS NOT NULL AND recipient_id <> actor_id""")
def derive_notifications(v):
    owners = c.target_owners(v.post, v.comment, v.review, v.mark, v.collection, v.activity)
    return d.derive_notifications(v.comment, c.first_per_key(v.reaction, ["user_id", "target_type", "target_id", "reaction_type"]), v.follow, owners).fillna(-1, ["source_id"])


def moderated(v):
    """Tables that moderation changes: posts, comments, and the activities that show one of them."""
    shown = v.activity.where("post_id IS NOT NULL").select("id", "post_id", F.lit(None).cast("long").alias("comment_id"), "feed_policy")
    return {"post": v.post, "comment": v.comment, "activity": shown.unionByName(v.comment_activity.select("id", "post_id", "comment_id", "feed_policy"))}


def states(tables):
    """(kind, id, is_hidden, is_locked) of the tables after moderation."""
    hidden = {"post": F.col("feed_policy") == "hidden", "activity": F.col("feed_policy") == "hidden", "comment": F.col("is_hidden")}
    one = [rows.select(F.lit(kind).alias("kind"), "id", hidden[kind].alias("is_hidden"), (F.lit(False) if kind == "activity" else F.col("is_locked")).alias("is_locked")) for kind, rows in tables.items()]
    return one[0].unionByName(one[1]).unionByName(one[2])


SHOWN_BY = "(SELECT id, post_id, CAST(NULL AS BIGINT) AS comment_id, feed_policy FROM {activity} WHERE post_id IS NOT NULL UNION ALL SELECT id, post_id, comment_id, feed_policy FROM {comment_activity})"


def state_sql(hide, lock):
    """What hide and lock lists (SQL for: kind, id) leave."""
    of = lambda x, kind, key: f"EXISTS (SELECT 1 FROM {x} h WHERE h.kind = '{kind}' AND h.id = {key})"
    return f"""SELECT 'post' AS kind, p.id, p.feed_policy = 'hidden' OR {of(hide, 'post', 'p.id')} AS is_hidden, {of(lock, 'post', 'p.id')} AS is_locked FROM {{post}} p
    UNION ALL SELECT 'comment', k.id, k.is_hidden OR {of(hide, 'comment', 'k.id')}, k.is_locked OR {of(lock, 'comment', 'k.id')} FROM {{comment}} k
    UNION ALL SELECT 'activity', a.id, a.feed_policy = 'hidden' OR {of(hide, 'activity', 'a.id')} OR {of(hide, 'post', 'a.post_id')} OR {of(hide, 'comment', 'a.comment_id')}, FALSE FROM {SHOWN_BY} a"""


ACTED = "(SELECT CASE WHEN comment_id IS NOT NULL THEN 'comment' ELSE 'post' END AS kind, coalesce(comment_id, post_id + CASE WHEN id % 5 = 0 THEN 100000000 ELSE 0 END) AS id, id % 2 = 0 OR id % 3 = 0 AS hides FROM {report} WHERE status = 'resolved')"


@query(state_sql(f"(SELECT * FROM {ACTED} x WHERE hides)", f"(SELECT * FROM {ACTED} x WHERE NOT hides)")
    + f" UNION ALL SELECT concat('acted ', kind), x.id, hides, NOT hides FROM {ACTED} x WHERE kind = 'comment' AND EXISTS (SELECT 1 FROM {{comment}} k WHERE k.id = x.id) OR kind = 'post' AND EXISTS (SELECT 1 FROM {{post}} p WHERE p.id = x.id)")
def apply_moderation(v):
    n = F.col("id")
    post = F.col("post_id") + F.when(n % 5 == 0, 100_000_000).otherwise(0)
    actions = v.report.where("status = 'resolved'").select(F.when(F.col("comment_id").isNotNull(), "comment").otherwise("post").alias("target_type"), F.coalesce("comment_id", post).alias("target_id"), F.when((n % 2 == 0) | (n % 3 == 0), "hide").otherwise("lock").alias("action_type"), F.lit(7).alias("moderator_id"))
    tables, done = m.apply_moderation(moderated(v), actions)
    hides = F.col("action_type") == "hide"
    rows = done.select(F.concat(F.lit("acted "), F.when(F.col("post_id").isNotNull(), "post").otherwise("comment")).alias("kind"), F.coalesce("post_id", "comment_id").alias("id"), hides.alias("is_hidden"), (~hides).alias("is_locked"))
    return states(tables).unionByName(rows)


REPORTS = """(SELECT id, reporter_id, status, CASE WHEN id % 5 > 1 THEN post_id END AS post_id, CASE WHEN id % 5 > 1 THEN comment_id END AS comment_id, CASE WHEN id % 5 = 0 THEN id END AS activity_id, CASE WHEN id % 5 = 1 THEN id END AS review_id, id % 90 AS reported_user_id FROM {report})"""
RESOLVED = f"(SELECT r.*, CASE WHEN id % 8 = 4 THEN NULL WHEN id % 3 = 0 THEN 'lock' ELSE 'hide' END AS action_type FROM {REPORTS} r WHERE status = 'pending' AND id % 4 = 0)"


def by_type(action):
    kinds = " UNION ALL ".join(f"SELECT '{k}' AS kind, {k}_id AS id FROM {RESOLVED} x WHERE action_type = '{action}' AND {k}_id IS NOT NULL" for k in ("post", "comment", "activity"))
    return f"(SELECT * FROM ({kinds}) y)"


@query(state_sql(by_type("hide"), by_type("lock")) + f""" UNION ALL SELECT concat('report ', CASE WHEN status = 'pending' AND id % 4 < 2 THEN CASE WHEN id % 4 = 0 THEN 'resolved' ELSE 'rejected' END ELSE status END), id, status = 'pending' AND id % 4 < 2, FALSE FROM {REPORTS} r
    UNION ALL SELECT concat_ws(' ', 'action', action_type, CASE WHEN post_id IS NOT NULL THEN 'post' WHEN comment_id IS NOT NULL THEN 'comment' WHEN activity_id IS NOT NULL THEN 'activity' ELSE 'review' END, CAST(reported_user_id AS STRING)), id, TRUE, TRUE FROM {RESOLVED} x WHERE action_type IS NOT NULL""")
def apply_reports(v):
    reports = v.spark.sql(REPORTS[1:-1], report=v.report)
    n = F.col("id")
    action = F.when(n % 8 == 4, None).when(n % 3 == 0, "lock").otherwise("hide")
    resolutions = v.report.where("id % 4 < 2").select("id", F.when(n % 4 == 0, "resolved").otherwise("rejected").alias("status"), action.alias("action_type"), F.lit(7).alias("moderator_id"))
    tables, done, actions = m.apply_reports(moderated(v), reports, resolutions)
    told = done.select(F.concat(F.lit("report "), "status").alias("kind"), "id", F.col("resolved_by").isNotNull().alias("is_hidden"), F.lit(False).alias("is_locked"))
    kind = F.coalesce(*[F.when(F.col(f"{k}_id").isNotNull(), F.lit(k)) for k in ("post", "comment", "activity", "review")])
    rows = actions.select(F.concat_ws(" ", F.lit("action"), "action_type", kind, F.col("target_user_id").cast("string")).alias("kind"), F.col("report_id").alias("id"), F.lit(True).alias("is_hidden"), F.lit(True).alias("is_locked"))
    return states(tables).unionByName(told).unionByName(rows)


TURNS = "(SELECT k.*, id // 1000 AS conv, CASE WHEN id % 5 <> 2 AND NOT is_hidden AND NOT is_locked THEN id * 7919 % 10007 END AS number FROM {comment} k)"
#: Conversations are chains: a comment is kept if from it on to the end some comment isn't deleted before the one it answers.
KEPT = f"(SELECT *, number IS NOT NULL AND max(CAST(bad AS INT)) OVER (PARTITION BY conv ORDER BY id DESC) = 0 AS gone FROM (SELECT *, number IS NULL OR coalesce(NOT coalesce(lead(number) OVER (PARTITION BY conv ORDER BY id) < number, FALSE) AND lead(id) OVER (PARTITION BY conv ORDER BY id) IS NOT NULL, FALSE) AS bad FROM {TURNS} t) x)"


@query(f"""SELECT 'comment' AS kind, k.id, CASE WHEN number IS NULL THEN length(content) ELSE 0 END AS n, is_hidden OR number IS NOT NULL AS is_hidden, is_spoiler AND number IS NULL AS is_spoiler, greatest(0, reply_count - (SELECT count(*) FROM {KEPT} g WHERE g.parent_id = k.id AND g.gone)) AS reply_count FROM {KEPT} k WHERE NOT gone
    UNION ALL SELECT 'post', p.id, 0, FALSE, FALSE, CASE WHEN reply_count > 0 THEN greatest(0, reply_count - (SELECT count(*) FROM {KEPT} g WHERE g.post_id = p.id AND g.gone)) ELSE reply_count END FROM {{post}} p
    UNION ALL SELECT 'activity', a.id, 0, feed_policy = 'hidden' OR number IS NOT NULL, FALSE, 0 FROM {{comment_activity}} a JOIN {KEPT} k ON k.id = a.comment_id WHERE NOT gone""")
def comment_deletes(v):
    list_ = v.comment.where("id % 5 <> 2").select("id", (F.col("id") * 7919 % 10007).alias("number"))
    comments, posts, activities = th.comment_deletes(v.comment, list_.unionByName(list_.withColumn("number", F.lit(20000).cast("long"))), v.post, v.comment_activity)
    zero, no = F.lit(0).cast("long"), F.lit(False)
    rows = comments.select(F.lit("comment").alias("kind"), "id", F.length("content").cast("long").alias("n"), "is_hidden", "is_spoiler", F.col("reply_count").cast("long").alias("reply_count"))
    rows = rows.unionByName(posts.select(F.lit("post").alias("kind"), "id", zero.alias("n"), no.alias("is_hidden"), no.alias("is_spoiler"), "reply_count"))
    return rows.unionByName(activities.select(F.lit("activity").alias("kind"), "id", zero.alias("n"), (F.col("feed_policy") == "hidden").alias("is_hidden"), no.alias("is_spoiler"), zero.alias("reply_count")))


def watched(rows):
    """Marks with dates: every eleventh would end before it starts."""
    start = F.to_date(F.col("created_at"))
    return rows.withColumns({"watch_start_date": start, "watch_end_date": F.when(F.col("id") % 5 != 0, F.date_add(start, F.when(F.col("id") % 11 == 0, -1).otherwise(3)))})


WATCHED = "(SELECT m.*, CAST(created_at AS DATE) AS starts, CASE WHEN id % 5 <> 0 THEN CAST(created_at AS DATE) + CASE WHEN id % 11 = 0 THEN -1 ELSE 3 END END AS ends FROM {mark} m)"


@query(f"""SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(o.subject_id, w.subject_id) AS subject_id, CASE WHEN w.user_id IS NULL THEN o.status ELSE 'wish' END AS status, coalesce(CASE WHEN w.user_id IS NULL THEN o.simple_rating ELSE 4 END, -1) AS simple_rating, CASE WHEN w.user_id IS NULL THEN round(o.rating, 6) ELSE -1 END AS rating,
    CASE WHEN w.user_id IS NULL THEN o.comment ELSE '' END AS comment, coalesce(CAST(CASE WHEN w.user_id IS NULL THEN o.starts ELSE w.starts END AS STRING), '') AS starts, coalesce(CAST(CASE WHEN w.user_id IS NULL THEN o.ends ELSE w.ends END AS STRING), '') AS ends, CASE WHEN w.user_id IS NULL THEN o.is_public ELSE TRUE END AS is_public, CASE WHEN o.user_id IS NULL THEN 'created' WHEN w.user_id IS NOT NULL THEN 'updated' END AS event
    FROM (SELECT * FROM {WATCHED} a WHERE id % 3 <> 0) o FULL JOIN (SELECT * FROM {WATCHED} b WHERE id % 2 = 0 AND coalesce(starts <= ends, TRUE) AND subject_id IN (SELECT id FROM {{subject}} WHERE subject_type IN ('anime', 'galgame'))) w ON w.user_id = o.user_id AND w.subject_id = o.subject_id""")
def merge_marks(v):
    new = watched(v.mark.where("id % 2 = 0")).select("id", "user_id", "subject_id", F.lit("wish").alias("status"), F.lit(4).alias("simple_rating"), "watch_start_date", "watch_end_date")
    rows = d.merge_marks(watched(v.mark.where("id % 3 <> 0")), new, v.subject)
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.fillna(-1, ["simple_rating", "rating"]).select("user_id", "subject_id", "status", "simple_rating", F.round("rating", 6).alias("rating"), "comment", day("watch_start_date").alias("starts"), day("watch_end_date").alias("ends"), "is_public", "event")


@query(f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'done' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN -1 ELSE coalesce(simple_rating, -1) END AS simple_rating, coalesce(CAST(CASE WHEN id % 6 = 0 AND (ends IS NULL OR starts + 1 <= ends) THEN starts + 1 ELSE starts END AS STRING), '') AS starts,
    CASE WHEN id % 6 = 0 AND (ends IS NULL OR starts + 1 <= ends) THEN 'moved' ELSE comment END AS comment, CAST((CASE WHEN id % 4 = 0 AND coalesce(starts <= ends, TRUE) THEN 1 ELSE 0 END) + (CASE WHEN id % 6 = 0 AND (ends IS NULL OR starts + 1 <= ends) THEN 1 ELSE 0 END) AS BIGINT) AS events FROM (SELECT * FROM {WATCHED} w WHERE coalesce(starts <= ends, TRUE)) x""")
def patch_marks(v):
    v.keep("mark")
    marks = watched(v.mark).where(d.ordered_dates())
    patch = lambda where, number, fields, **values: marks.where(where).select("id", F.lit(number).alias("number"), F.array(*map(F.lit, fields)).alias("fields"), *[values.get(c, F.lit(None)).cast(marks.schema[c].dataType).alias(c) for c in d.SET_FIELDS])
    patches = patch("id % 6 = 0", 2, ["watch_start_date", "comment"], watch_start_date=F.date_add("watch_start_date", 1), comment=F.lit("moved")).unionByName(patch("id % 4 = 0", 1, ["status", "simple_rating"], status=F.lit("done"))).unionByName(patch("id % 9 = 0", 3, ["none of them"]))
    out, done = d.patch_marks(marks, patches)
    events = done.groupBy("id").agg(F.count("*").alias("events"))
    return out.join(events, "id", "left").fillna(-1, ["simple_rating"]).fillna(0, ["events"]).select("id", "status", "simple_rating", F.coalesce(F.col("watch_start_date").cast("string"), F.lit("")).alias("starts"), "comment", "events")


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 99 ELSE place END AS place, CASE WHEN id % 21 = 0 THEN 'sequel' WHEN id % 5 = 0 THEN 'prequel' ELSE '' END AS relation FROM {item} UNION ALL SELECT -id, -1, 'unknown' FROM {item} WHERE id % 35 = 0")
def patch_items(v):
    items = v.item.withColumn("relation", F.lit(""))
    patch = lambda where, number, place, relation, id="id": v.item.where(where).select(F.expr(id).alias("id"), F.lit(place).cast("int").alias("place"), F.lit(relation).cast("string").alias("relation"), F.lit(number).alias("number"))
    patches = patch("id % 7 = 0", 1, 98, None).unionByName(patch("id % 7 = 0", 2, 99, None)).unionByName(patch("id % 5 = 0", 1, None, "prequel")).unionByName(patch("id % 21 = 0", 2, None, "sequel")).unionByName(patch("id % 35 = 0", 1, 1, "x", "-id"))
    patched, unknown = d.patch_items(items, patches)
    return patched.select("id", "place", "relation").unionByName(unknown.select("id", F.lit(-1).alias("place"), F.lit("unknown").alias("relation")))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN place ELSE row_number() OVER (PARTITION BY collection_id ORDER BY id) - 1 END AS place FROM {item}")
def item_order(v):
    return d.item_order(v.item.withColumn("place", F.when(F.col("id") % 2 == 0, F.col("place")))).select("id", F.col("place").cast("long").alias("place"))
