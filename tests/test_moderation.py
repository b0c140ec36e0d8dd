"""Deletes, moderation and reports against plain versions that go through them one after the other."""

import random

from pyspark.sql import functions as F

from reelgraph.operators import community, derive, moderation, threads

COMMENT = "id long, parent_id long, post_id long, content string, is_hidden boolean, is_locked boolean, is_spoiler boolean, reply_count long"


def one_by_one(comments, deletes, posts, activities):
    """The same, a delete at a time."""
    rows, posts, acts = {c["id"]: dict(c) for c in comments}, dict(posts), {a[0]: list(a) for a in activities}
    for _, i in sorted(deletes):
        c = rows.get(i)
        if c is None or c["is_hidden"] or c["is_locked"]:
            continue
        if any(r["parent_id"] == i for r in rows.values()):
            c.update(content="", is_hidden=True, is_spoiler=False)
            for a in acts.values():
                if a[1] == i:
                    a[2] = "hidden"
            continue
        if posts.get(c["post_id"], 0) > 0:
            posts[c["post_id"]] -= 1
        parent = rows.get(c["parent_id"])
        if parent and parent["reply_count"] > 0:
            parent["reply_count"] -= 1
        del rows[i]
        acts = {k: a for k, a in acts.items() if a[1] != i}
    return rows, posts, acts


def run(spark, comments, deletes, posts, activities):
    a = spark.createDataFrame([tuple(c.values()) for c in comments], COMMENT).repartition(3)
    b = spark.createDataFrame([(i, n) for n, i in deletes], "id long, number long")
    p = spark.createDataFrame(list(posts.items()), "id long, reply_count long")
    t = spark.createDataFrame(activities, "id long, comment_id long, feed_policy string")
    x, y, z = threads.comment_deletes(a, b, p, t)
    return {r["id"]: r.asDict() for r in x.collect()}, {r["id"]: r["reply_count"] for r in y.collect()}, {r["id"]: list(r) for r in z.collect()}


def comment(i, parent, post, **more):
    return {"id": i, "parent_id": parent, "post_id": post, "content": f"text {i}", "is_hidden": False, "is_locked": False, "is_spoiler": i % 2 == 0, "reply_count": 0} | more


def test_deletes_of_random_trees(spark):
    for seed in range(5):
        draw = random.Random(seed)
        # Many trees at once: bushes, chains and a single root, with counts that are right, too high and too low.
        comments = []
        for i in range(260):
            tree = i // 26
            parent = None if i % 26 == 0 or draw.random() < 0.1 else (i - 1 if tree % 3 == 0 else tree * 26 + draw.randrange(i % 26))
            comments.append(comment(i, parent, draw.choice((None, tree, tree)), is_hidden=draw.random() < 0.04, is_locked=draw.random() < 0.04))
        for c in comments:
            c["reply_count"] = max(0, sum(x["parent_id"] == c["id"] for x in comments) + draw.choice((0, 0, -2, 1)))
        order = sorted(range(260), key=lambda i: -i if seed % 2 else draw.random())
        deletes = [(n, i) for n, i in enumerate(order) if draw.random() < 0.85] + [(500 + k, draw.randrange(300)) for k in range(40)]
        posts = {k: draw.choice((0, 3, 40, -1)) for k in range(10)}
        activities = [(1000 + i, i, "normal") for i in range(0, 260, 2)] + [(5000, None, "normal")]
        want, got = one_by_one(comments, deletes, posts, activities), run(spark, comments, deletes, posts, activities)
        assert got == want and 20 < len(want[0]) < 240


def test_reply_before_parent_and_after(spark):
    chain = [comment(1, None, 9, reply_count=1), comment(2, 1, 9, reply_count=1), comment(3, 2, 9)]
    after = lambda *order: sorted(run(spark, chain, list(enumerate(order)), {9: 2}, [(7, 1, "normal")])[0])
    assert after(3, 2, 1) == [] and after(1, 2, 3) == [1, 2] and after(2, 3, 1) == [1, 2] and after(3, 1, 2) == [1]
    assert run(spark, chain, [(1, 3), (2, 2), (3, 1)], {9: 2}, [(7, 1, "normal")])[1:] == ({9: 0}, {})


def test_deep_chains_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(threads, "stored", lambda rows, f=threads.stored: written.append(1) or f(rows))
    parents = spark.range(1, 700).select("id", (F.col("id") - 1).alias("up"))
    marks = threads.with_ancestors(spark.createDataFrame([(650,)], "id long"), parents)
    assert marks.count() == 651 and len(written) <= 2 + 2 * 12
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, up long")
    assert sorted(r["id"] for r in threads.with_ancestors(spark.createDataFrame([(2,)], "id long"), circle).collect()) == [1, 2, 3]


def tables(spark):
    post = spark.createDataFrame([(1, 11, "normal"), (2, 12, "featured"), (3, 13, "normal")], "id long, author_id long, feed_policy string")
    comments = spark.createDataFrame([(1, 21, False, True), (2, 22, False, False), (3, 23, True, False)], "id long, author_id long, is_hidden boolean, is_locked boolean")
    shown = spark.createDataFrame([(100, 1, None, "normal"), (101, 1, 2, "featured"), (102, None, 1, "normal"), (103, None, None, "normal"), (104, 3, None, "normal")], "id long, post_id long, comment_id long, feed_policy string")
    return {"post": post, "comment": comments, "activity": shown}


def state(tables):
    return {k: {r["id"]: (r["feed_policy"] if k != "comment" else r["is_hidden"], r["is_locked"] if k != "activity" else None) for r in t.collect()} for k, t in tables.items()}


def test_hide_reaches_activities_and_lock_does_not(spark):
    actions = spark.createDataFrame([("post", 1, "hide", 5), ("post", 1, "hide", 6), ("post", 2, "lock", 5), ("comment", 2, "hide", 5), ("comment", 2, "lock", 5), ("comment", 9, "hide", 5), ("post", 3, "praise", 5)], "target_type string, target_id long, action_type string, moderator_id long")
    out, rows = moderation.apply_moderation(tables(spark), actions)
    got = state(out)
    assert got["post"] == {1: ("hidden", False), 2: ("featured", True), 3: ("normal", False)} and got["comment"] == {1: (False, True), 2: (True, True), 3: (True, False)}
    assert {i: p for i, (p, _) in got["activity"].items()} == {100: "hidden", 101: "hidden", 102: "normal", 103: "normal", 104: "normal"}
    assert sorted((r["post_id"] or 0, r["comment_id"] or 0, r["action_type"], r["moderator_id"], r["target_user_id"]) for r in rows.collect()) == [(0, 2, "hide", 5, 22), (0, 2, "lock", 5, 22), (1, 0, "hide", 5, 11), (1, 0, "hide", 6, 11), (2, 0, "lock", 5, 12)]


def test_reports_of_every_kind(spark):
    reports = spark.createDataFrame([(1, "pending", 1, None, None, None, None, 11), (2, "pending", None, 1, None, None, None, 21), (3, "pending", None, None, 104, None, None, 13), (4, "pending", None, None, None, 7, None, 31), (5, "pending", None, None, None, None, 8, 41), (6, "resolved", 3, None, None, None, None, 13), (7, "pending", 3, None, None, None, None, 13), (8, "pending", 3, None, None, None, None, 13)], "id long, status string, post_id long, comment_id long, activity_id long, review_id long, collection_id long, reported_user_id long")
    done = [(1, "resolved", "hide", 9), (2, "rejected", "hide", 9), (3, "resolved", "hide", 9), (4, "resolved", "lock", 9), (5, "resolved", "hide", 9), (6, "resolved", "hide", 9), (7, "resolved", None, 9), (3, "rejected", None, 1)]
    out, closed, rows = moderation.apply_reports(tables(spark), reports, spark.createDataFrame(done, "id long, status string, action_type string, moderator_id long"))
    got = state(out)
    assert got["post"] == {1: ("hidden", False), 2: ("featured", False), 3: ("normal", False)} and got["comment"] == {1: (False, True), 2: (False, False), 3: (True, False)}
    assert {i: p for i, (p, _) in got["activity"].items()} == {100: "hidden", 101: "hidden", 102: "normal", 103: "normal", 104: "hidden"}
    assert {r["id"]: (r["status"], r["resolved_by"]) for r in closed.collect()} == {1: ("resolved", 9), 2: ("rejected", 9), 3: ("resolved", 9), 4: ("resolved", 9), 5: ("resolved", 9), 6: ("resolved", None), 7: ("resolved", 9), 8: ("pending", None)}
    named = sorted((r["report_id"], r["action_type"], r["target_user_id"], *[k for k in moderation.TARGETS if r[f"{k}_id"] is not None]) for r in rows.collect())
    assert named == [(1, "hide", 11, "post"), (3, "hide", 13, "activity"), (4, "lock", 31, "review"), (5, "hide", 41, "collection")]


def test_comments_on_every_kind_of_target(spark):
    comments = spark.createDataFrame([(1, None, 5, None, None, None, 50), (2, None, None, 6, None, None, 50), (3, None, None, None, 7, None, 50), (4, None, None, None, None, 8, 50), (5, 2, None, 6, None, None, 51), (6, 5, None, 6, None, None, 51)], "id long, parent_id long, post_id long, review_id long, collection_id long, activity_id long, author_id long").withColumns({"visibility": F.lit("public"), "is_hidden": F.lit(False)})
    owners = spark.createDataFrame([("post", 5, 60), ("review", 6, 61), ("collection", 7, 50), ("activity", 8, 62)], "target_type string, target_id long, owner_id long")
    none = spark.createDataFrame([], "id long, user_id long, target_type string, target_id long"), spark.createDataFrame([], "follower_id long, following_id long")
    told = sorted((r["source_id"], r["recipient_id"]) for r in derive.derive_notifications(comments, *none, owners).collect())
    assert told == [(1, 60), (2, 61), (4, 62), (5, 50)]
    posts = spark.createDataFrame([(5, 60, "private", "normal")], "id long, author_id long, visibility string, feed_policy string")
    empty = lambda s: spark.createDataFrame([], s)
    open_ = community.public_targets(posts, comments, empty("id long, mark_id long, is_public boolean"), empty("id long, user_id long, is_public boolean"), empty("id long, user_id long, is_public boolean"), empty("id long, user_id long"))
    assert sorted(r["target_id"] for r in open_.collect()) == [1, 2, 3, 4, 5, 6]
