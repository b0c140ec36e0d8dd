"""Rules that the synthetic tables don't reach, on small fixtures."""

import datetime

from pyspark.sql import functions as F

from reelgraph.functions.order import ordering
from reelgraph.functions.text import cleaned, contains, similarity
from reelgraph.operators import audit, catalog, community, derive, edges, ingest, library
from reelgraph.sources import tables


def column(df, name):
    return [r[name] for r in df.collect()]


def test_null_places(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, 7)], "id int, date int")
    assert column(df.orderBy(*ordering("-date")), "id") == [1, 4, 3, 2]
    assert column(df.orderBy(*ordering("date")), "id") == [2, 4, 3, 1]


def test_page(spark):
    r = catalog.page(spark.range(8), [F.col("id")], 2, 3).collect()
    assert [x["id"] for x in r] == [3, 4, 5] and r[0]["total"] == 8


def test_clean(spark):
    df = spark.createDataFrame([("  value  ",), (None,), ("　x ",)], "s string")
    assert column(df.select(cleaned(F.col("s"), 4).alias("v")), "v") == ["valu", "", "x"]


def test_contains_is_literal(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), (None,)], "s string")
    assert column(df.select(contains(F.col("s"), "0% O").alias("v")), "v") == [True, False, False]


def test_similarity(spark):
    df = spark.createDataFrame([("word", "two words"), ("", "x"), ("", ""), (None, "x"), ("cat", "CAT")], "a string, b string")
    assert [round(x, 6) for x in column(df.select(similarity(F.col("a"), F.col("b")).alias("v")), "v")] == [0.363636, 0, 0, 0, 1]


def test_search_many_agrees_with_scores(spark):
    subjects = spark.createDataFrame([(1, "red widget", ""), (2, "widgets of red", "x"), (3, "blue", None)], "id long, title string, title_cn string")
    keys = spark.createDataFrame([("red widget",), ("blue",), ("",)], "keyword string")
    found = {(r["keyword"], r["id"]): r["score"] for r in catalog.search_many(subjects, keys).collect()}
    for (k, i), score in found.items():
        one = subjects.where(F.col("id") == i).select(F.greatest(similarity(F.col("title"), F.lit(k)), similarity(F.col("title_cn"), F.lit(k))).alias("v")).first()["v"]
        assert abs(one - score) < 1e-12
    assert set(found) == {("red widget", 1), ("red widget", 2), ("blue", 3)}
    more = spark.createDataFrame([("D W",), ("x",), ("GET",), ("zz",), (None,)], "keyword string")
    want = {(k, r["id"]): r["score"] for k in ("D W", "x", "GET", "zz") for r in catalog.scored(subjects, k).collect()}
    assert {(r["keyword"], r["id"]): r["score"] for r in catalog.search_many(subjects, more).collect()} == want and set(want) == {("D W", 1), ("x", 2), ("GET", 1), ("GET", 2)}


def test_mutes_hide_posts_but_not_reviews(spark):
    block = spark.createDataFrame([(1, 2)], "user_id long, target_id long")
    mute = spark.createDataFrame([(1, 3)], "user_id long, target_id long")
    assert {tuple(r) for r in edges.hidden_authors(block, mute).collect()} == {(1, 2), (2, 1), (1, 3)}
    assert {tuple(r) for r in edges.hidden_authors(block).collect()} == {(1, 2), (2, 1)}
    asked = spark.createDataFrame([(2, 1), (1, 1), (1, 3)], "viewer_id long, author_id long")
    assert {tuple(r) for r in edges.profile_gate(asked, block).collect()} == {(1, 1), (1, 3)}


def test_frontier(spark):
    def run(text, skips, errors):
        names = {"s": "synced", "k": "skipped", "f": "failed"}
        rows = spark.createDataFrame([("t", i + 10, names[c]) for i, c in enumerate(text)], "task string, entity long, outcome string")
        end = spark.createDataFrame([("t", 9 + len(text))], "task string, end_id long")
        found = {tuple(ingest.sync_frontier(rows, end, skips, errors, size).first())[1:] for size in (1, 2, 3, 16_384)}
        assert len(found) == 1
        return found.pop()

    assert run("skfkk", 3, 9) == (10, "skips")  # failures don't break a run of skips
    assert run("kkk", 3, 9) == (9, "skips")  # nothing synced before
    assert run("sffsff", 9, 2) == (10, "errors")
    assert run("skskf", 2, 2) == (14, "end")


def test_frontier_of_random_scans_over_borders_of_ranges(spark):
    import random

    draw, rows, want = random.Random(9), [], {}
    skips, errors = 6, 4
    for task in range(60):
        first, n = draw.randrange(50), draw.randrange(1, 120)
        weights = draw.choice(((6, 3, 1), (1, 6, 1), (1, 1, 6), (2, 9, 9), (1, 0, 9)))
        skipping = failing = 0
        cursor, why = first - 1, "end"
        for k, outcome in enumerate(draw.choices(("synced", "skipped", "failed"), weights, k=n)):
            rows.append((f"t{task}", first + k, outcome))
            if why == "end":
                failing = failing + 1 if outcome == "failed" else 0
                skipping = 0 if outcome == "synced" else skipping + (outcome == "skipped")
                cursor = first + k if outcome == "synced" else cursor
                why = "skips" if skipping >= skips else "errors" if failing >= errors else "end"
        want[f"t{task}"] = (first + n - 1 if why == "end" else cursor, why)
    df = spark.createDataFrame(rows, "task string, entity long, outcome string").repartition(4)
    end = df.groupBy("task").agg(F.max("entity").alias("end_id"))
    assert set(w for _, w in want.values()) == {"end", "skips", "errors"}
    for size in (1, 5, 1000):
        assert {r["task"]: (r["cursor"], r["stopped"]) for r in ingest.sync_frontier(df, end, skips, errors, size).collect()} == want


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "s", "1", "a", "n")], "id int, info_source string, id_source string, title string, note string")
    new = spark.createDataFrame([(9, "s", "1", "b"), (2, "s", "2", "c")], "id int, info_source string, id_source string, title string")
    once = tables.upsert(old, new)
    assert {tuple(r) for r in once.collect()} == {(1, "s", "1", "b", "n"), (2, "s", "2", "c", None)} == {tuple(r) for r in tables.upsert(once, new).collect()}


def test_relation_diff_of_equal_is_empty(spark):
    links = spark.createDataFrame([(1, 2, "r"), (3, 4, "r")], "subject_id long, target_id long, relation string")
    assert ingest.relation_diff(links, links, links, "subject_id").count() == 0
    one = spark.createDataFrame([(1,)], "subject_id long")
    assert [tuple(r) for r in ingest.relation_diff(links, links.limit(0), one, "subject_id").collect()] == [(1, 2, "r", "delete")]


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("s", "1", "a", 0), ("s", "1", "b", 1)], "info_source string, id_source string, title string, place int")
    assert column(tables.last_by_place(rows, tables.IDENTITY, ["place"]), "title") == ["b"]


def test_cover_hosts(spark):
    urls = ["https://img.example.org/a.jpg", "https://cdn.img.example.org/a.jpg", "file:///etc/passwd", "https://img.example.org.evil.com/a", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(ingest.cover_pick({"large": F.col("u")}, ["img.example.org"]).alias("v"))
    assert column(df, "v") == [urls[0], urls[1], None, None, None, None]


def test_rejected_payloads_are_kept(spark, tmp_path):
    lines = ['{"id": 1, "name": "a"}', "", "   ", "{", "[1]", "5", '{"id": "x"}', '{"id": 0}', '{"id": 2.5}', '{"name": "no id asked for"}', '{"id": 3}', "null"]
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n")
    for _ in range(2):
        rows = tables.read_payloads(spark, str(tmp_path / "a.json"), "subject", str(tmp_path / "rejects")).collect()
    bad = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert len(rows) + len(bad) / 2 == len(lines) == 12 and all(r["file"].endswith("a.json") for r in [*rows, *bad])
    assert sorted((r["reason"], r["landed"]) for r in bad)[::2] == sorted([("empty", ""), ("empty", "   "), ("not JSON", "{"), ("not an object", "[1]"), ("not an object", "5"), ("not an object", "null"), ("no id", '{"id": "x"}'), ("no id", '{"id": 0}'), ("no id", '{"id": 2.5}')])
    assert tables.read_payloads(spark, str(tmp_path / "a.json"), "subject").count() == 3


def test_visible_activities_follow_changes(spark):
    import random

    draw = random.Random(4)
    flag = lambda: draw.random() < 0.6
    some = lambda n: draw.choice((None, draw.randrange(n)))
    t = {"mark": {i: [i, flag()] for i in range(60)}, "collection": {i: [i, flag()] for i in range(30)}, "review": {i: [i, draw.randrange(70), flag()] for i in range(40)}, "item": {i: [i, draw.randrange(70), draw.randrange(35)] for i in range(50)}}
    t["activity"] = {i: [i, draw.choice(("public", "public", "private")), draw.choice(("normal", "normal", "hidden")), some(70), some(45), some(35), some(55)] for i in range(400)}
    schemas = {"mark": "id long, is_public boolean", "collection": "id long, is_public boolean", "review": "id long, mark_id long, is_public boolean", "item": "id long, mark_id long, collection_id long", "activity": "id long, visibility string, feed_policy string, mark_id long, review_id long, collection_id long, item_id long"}
    frames = lambda: {k: spark.createDataFrame([tuple(r) for r in rows.values()], schemas[k]) for k, rows in t.items()}
    full = lambda f: {r["id"] for r in community.visible_activities(f["activity"], f["mark"], f["review"], f["collection"], f["item"]).select("id").collect()}
    seen = full(frames())
    for _ in range(3):
        changed = {k: set() for k in t}
        for kind, n in (("mark", 6), ("collection", 3), ("review", 4), ("activity", 9)):
            for i in draw.sample(sorted(t[kind]), n):
                changed[kind].add(i)
                if draw.random() < 0.2:
                    del t[kind][i]
                elif kind == "activity":
                    t[kind][i][2] = draw.choice(("normal", "hidden"))
                else:
                    t[kind][i][-1] = not t[kind][i][-1]
        new = 1000 + len(seen)
        t["activity"][new] = [new, "public", "normal", None, None, None, draw.randrange(50)]
        i = draw.randrange(50)
        t["item"][i] = [i, draw.randrange(60), draw.randrange(30)]
        changed["activity"].add(new)
        changed["item"].add(i)
        f = frames()
        ids = {k: spark.createDataFrame([(i,) for i in v], "id long") for k, v in changed.items()}
        old = spark.createDataFrame([(i,) for i in seen], "id long")
        touched = community.touched_activities(f["activity"], ids, f["review"], f["item"]).count()
        delta = community.visible_changes(old, f["activity"], ids, f["mark"], f["review"], f["collection"], f["item"])
        after = {r["id"] for r in community.with_changes(old, delta).collect()}
        assert after == full(f) and after != seen and touched < 300
        seen = after


def test_orphans_of_a_parent_that_many_name(spark):
    child = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, 99).when(F.col("id") % 50 == 2, None).otherwise(F.col("id") % 40).cast("long").alias("parent_id"))
    parent = spark.range(40).select("id")
    got = audit.audit_orphans([("r", child, "parent_id", parent, "id")])
    assert {int(r["key"]) for r in got.collect()} == {i for i in range(2000) if i % 3 and i % 50 == 1}


def test_payload_types(spark):
    text = ['{"id": 1, "name": " A ", "type": 2, "date": "2001-02-03", "nsfw": true, "infobox": [{"key": "k", "value": ["x"]}]}', '{"name": 5, "type": "2", "date": "2001-02-30", "nsfw": 1, "eps": true}', "[1]", "{", None]
    rows, _ = tables.quarantined(tables.parsed(spark.createDataFrame([(t,) for t in text], "value string"), "subject"))
    out = ingest.map_subjects(rows).collect()
    assert [r["title"] for r in out] == ["A", ""] and [r["subject_type"] for r in out] == ["anime", "other"]
    assert [r["date"] for r in out] == [datetime.date(2001, 2, 3), None] and [r["nsfw"] for r in out] == [True, False] and out[1]["eps"] is None


def test_counts_don_t_multiply(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    rows = spark.createDataFrame([(1,), (1,)], "user_id long")
    assert {tuple(r) for r in library.counted(users, {"a": rows, "b": rows}).collect()} == {(1, 2, 2), (2, 0, 0)}


def test_snapshot_keeps_old_when_empty(spark):
    old = spark.createDataFrame([("a", 1)], "info_source string, id long")
    assert tables.replace_snapshot(old, old.limit(0)).count() == 1


def test_first_line_and_empty_post(spark):
    posts = spark.createDataFrame([(1, "a\nb", None), (2, "", 5), (3, None, 6)], "id long, content string, subject_id long")
    marks = spark.createDataFrame([(i, 1, i, None, None, i) for i in (1, 2, 3)], "id long, user_id long, post_id long, review_id long, collection_id long, created_at int")
    none = spark.createDataFrame([], "id long, title string, content string, mark_id long"), spark.createDataFrame([], "id long, name string, note string")
    subject = spark.createDataFrame([(5, "Red", "")], "id long, title string, title_cn string")
    mark = spark.createDataFrame([], "id long, subject_id long")
    assert {r["id"]: r["title"] for r in community.bookmarks_list(marks, posts, *none, mark, subject).collect()} == {1: "a", 2: "", 3: ""}
    assert column(community.bookmarks_list(marks, posts, *none, mark, subject, keyword="red"), "id") == [2]
    assert not community.bookmarks_list(marks, posts, *none, mark, subject, target_type="review").count()


def test_list_orders(spark):
    """All orderings of a list, downwards with nulls first; unknown ones fall back to the list's own."""
    day = lambda d: d and datetime.date(2026, 7, d)
    marks = spark.createDataFrame([(i, 1, 7, "done", r, None, c, c, day(w), None, True, "") for i, r, c, w in ((1, 3, 5, 2), (2, None, 4, None), (3, 3, 6, 1))], "id long, user_id long, subject_id long, status string, simple_rating int, rating double, created_at int, updated_at int, watch_start_date date, watch_end_date date, is_public boolean, comment string")
    subjects = spark.createDataFrame([(7, "t", "", "anime")], "id long, title string, title_cn string, subject_type string")
    own = lambda o: [r["id"] for r in sorted(library.library_list(marks, subjects, order=o).collect(), key=lambda r: r["place"])]
    want = {"created_at": [2, 1, 3], "-created_at": [3, 1, 2], "updated_at": [2, 1, 3], "-updated_at": [3, 1, 2], "simple_rating": [3, 1, 2], "-simple_rating": [2, 3, 1], "rating": [3, 2, 1], "-rating": [3, 2, 1], "watch_start_date": [3, 1, 2], "-watch_start_date": [2, 1, 3], "watch_end_date": [3, 2, 1], "-watch_end_date": [3, 2, 1], "email": [3, 1, 2], "id": [3, 1, 2]}
    assert {o: own(o) for o in want} == want
    public = lambda o: [r["id"] for r in sorted(library.public_library(marks, subjects, order=o).collect(), key=lambda r: r["place"])]
    assert public("id") == [1, 2, 3] and public("email") == public("created_at") == public(None) == [3, 2, 1] and public("-watch_start_date") == [2, 1, 3]


def test_posts_without_activity_come_last(spark):
    posts = spark.createDataFrame([(i, 9, 7, "public", "normal", "x", a, i, 0, 0) for i, a in ((1, 5), (2, None), (3, 6))], "id long, author_id long, subject_id long, visibility string, feed_policy string, content string, last_activity_at int, created_at int, reaction_count long, reply_count long")
    viewers, hidden = spark.createDataFrame([(1, 7)], "viewer_id long, subject_id long"), spark.createDataFrame([], "viewer_id long, author_id long")
    listed = lambda o: [r["id"] for r in sorted(community.posts_list(posts, viewers, hidden, order=o).collect(), key=lambda r: r["place"])]
    assert listed("-last_activity_at") == listed("author") == listed(None) == [3, 1, 2] and listed("last_activity_at") == [1, 3, 2] and listed("reply_count") == [3, 2, 1]


def test_global_feed_of_one_who_hides_the_largest_author(spark):
    rows = [(i, 1 if i < 400 else 2 + i % 3, i) for i in range(0, 500)] + [(1000 + i, 1, 1000 + i) for i in range(300)]
    visible = spark.createDataFrame(rows, "id long, user_id long, created_at int").repartition(5)
    viewers = spark.createDataFrame([(8,), (9,), (10,)], "viewer_id long")
    hidden = spark.createDataFrame([(9, 1), (10, 1), (10, 2), (10, 3), (10, 4)], "viewer_id long, author_id long")
    got = {}
    for r in community.global_feed(visible, viewers, hidden, k=5).collect():
        got.setdefault(r["viewer_id"], {})[r["rank"]] = r["id"]
    assert got == {8: {n + 1: 1299 - n for n in range(5)}, 9: {n + 1: 499 - n for n in range(5)}}


def test_author_followed_by_all(spark):
    """A hot author's edges are dealt to several places, none of which holds many more than the limit."""
    edges_ = spark.range(3000).select(F.col("id").alias("viewer_id"), F.lit(1).cast("long").alias("author_id")).unionByName(spark.range(50).select(F.col("id").alias("viewer_id"), (F.col("id") + 2).alias("author_id")))
    visible = spark.createDataFrame([(i, i % 5, i) for i in range(40)], "id long, user_id long, created_at int")
    rows = visible.withColumnRenamed("user_id", "author_id")
    plain = sorted((r["viewer_id"], r["id"]) for r in edges_.join(rows, "author_id").collect())
    assert sorted((r["viewer_id"], r["id"]) for r in community.following_feed(visible, edges_, limit=100).collect()) == plain
    pages = [sorted((r["viewer_id"], r["rank"], r["id"]) for r in community.feed_top_k(visible, edges_, 3, limit=n).collect()) for n in (100, 10**6)]
    assert pages[0] == pages[1] and {v for v, *_ in pages[0]} == set(range(3000))
    hot = community.fan_out(edges_, rows, 100).groupBy("author_id", F.pmod(F.xxhash64("viewer_id"), F.lit(30))).agg(F.countDistinct("viewer_id").alias("n"))
    assert hot.agg(F.max("n")).first()[0] < 200


def test_global_feed_of_one_who_hides_thousands(spark):
    visible = spark.range(6000).select("id", (F.col("id") % 3000).alias("user_id"), F.col("id").cast("int").alias("created_at"))
    viewers = spark.createDataFrame([(-1,), (-2,), (-3,)], "viewer_id long")
    hidden = spark.range(3, 3000).select(F.lit(-1).cast("long").alias("viewer_id"), F.col("id").alias("author_id")).unionByName(spark.range(3000).select(F.lit(-2).cast("long").alias("viewer_id"), F.col("id").alias("author_id")))
    for most in (100, 4096):
        rows = {(r["viewer_id"], r["rank"]): r["id"] for r in community.global_feed(visible, viewers, hidden, 4, most=most).collect()}
        assert rows == {(-1, 1): 3002, (-1, 2): 3001, (-1, 3): 3000, (-1, 4): 2} | {(-3, n + 1): 5999 - n for n in range(4)}
    assert not community.global_feed(visible.limit(0), viewers, hidden, 4).count()


def test_feeds_in_other_orders(spark):
    visible = spark.createDataFrame([(i, i % 3, i * 7 % 50) for i in range(50)], "id long, user_id long, created_at int")
    viewers = spark.createDataFrame([(8,)], "viewer_id long")
    edges_ = spark.createDataFrame([(8, 1), (8, 2)], "viewer_id long, author_id long")
    hidden = spark.createDataFrame([(8, 0)], "viewer_id long, author_id long")
    seen = [(i * 7 % 50, i) for i in range(50) if i % 3]
    want = {"created_at": [i for _, i in sorted(seen)][:6], "-created_at": [i for _, i in sorted(seen, reverse=True)][:6], "id": [1, 2, 4, 5, 7, 8], "-id": [49, 47, 46, 44, 43, 41], "random": [i for _, i in sorted(seen, reverse=True)][:6]}
    for order, ids in want.items():
        for feed in (community.feed_top_k(visible, edges_, 6, order), community.global_feed(visible, viewers, hidden, 6, order)):
            assert [r["id"] for r in sorted(feed.collect(), key=lambda r: r["rank"])] == ids


def test_positions(spark):
    rows = spark.createDataFrame([(i, i * 7919 % 1000) for i in range(1000)], "id long, key int").repartition(7)
    got = community.positions(rows, [F.desc("key")]).collect()
    assert sorted((r["position"], r["key"]) for r in got) == [(n + 1, 999 - n) for n in range(1000)]


def test_repeated_keys_in_a_batch(spark):
    items = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "id long, place int, relation string")
    patches = spark.createDataFrame([(1, 7, None, 1), (1, None, "c", 2), (1, 8, None, 3), (3, 1, "x", 4), (3, 2, "y", 5)], "id long, place int, relation string, number int")
    out, unknown = derive.patch_items(items, patches)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 8, "c"), (2, 6, "b")] and column(unknown, "id") == [3]
    old = spark.createDataFrame([], "user_id long, subject_id long, status string")
    new = spark.createDataFrame([(1, 7, "wish", 1), (1, 7, "done", 2)], "user_id long, subject_id long, status string, id long")
    subjects = spark.createDataFrame([(7, "anime")], "id long, subject_type string")
    assert [tuple(r) for r in derive.merge_marks(old, new, subjects).collect()] == [(1, 7, "done", "created")]
    one = spark.createDataFrame([("s", "1", "a", 0), ("s", "1", "b", 1)], "info_source string, id_source string, title string, place int")
    assert column(tables.upsert(one.limit(0).drop("place"), one, place=["place"]), "title") == ["b"]


def test_followers_newest_first(spark):
    follows = spark.createDataFrame([(1, 9, 5), (2, 9, 7), (9, 1, 1)], "follower_id long, following_id long, created_at int")
    profiles = spark.createDataFrame([(1, "a")], "user_id long, nickname string")
    got = sorted(tuple(r[c] for c in ("kind", "user_id", "place", "other_id", "nickname")) for r in edges.follow_lists(follows, profiles).collect())
    assert got == [("follower", 1, 1, 9, ""), ("follower", 9, 1, 2, ""), ("follower", 9, 2, 1, "a"), ("following", 1, 1, 9, ""), ("following", 2, 1, 9, ""), ("following", 9, 1, 1, "a")]


def test_lists_in_several_orders(spark):
    """Each order gives what it gives alone, unknown ones too; the table is scanned once, and a `place` of its own is replaced."""
    from reelgraph.functions.order import listed

    rows = spark.createDataFrame([(1, 1, 5, 9), (2, 1, None, 9), (3, 1, 4, 9), (4, 2, 1, 9)], "id long, user_id long, n int, place int")
    orders = ["n", "-n", "id", "unknown"]
    got = listed(rows, "user_id", orders, ("n", "id"), "-id")
    assert got.columns == ["id", "user_id", "n", "sorted", "place"]
    want = {(o, r["id"], r["place"]) for o in orders for r in listed(rows, "user_id", o, ("n", "id"), "-id").collect()}
    assert {(r["sorted"], r["id"], r["place"]) for r in got.collect()} == want and len(want) == 16 and got.count() == 16
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert listed(rows, "user_id", [], ("n", "id"), "-id").count() == 0


def test_all_declared_unique_keys_are_checked(spark):
    from reelgraph.plans import queries_ingest
    from reelgraph.plans.fixture_views import Views

    from .conftest import DATA

    v = Views(spark, DATA)
    # Per table: a key twice, one of its own, and keys without a target, which repeat nothing.
    texts = {
        "reaction": "user_id, target_type, target_id, reaction_type FROM VALUES (1, 'post', 2, 'like'), (1, 'post', 2, 'like'), (1, 'post', 2, 'agree')", "mark": "id, user_id, subject_id FROM VALUES (1, 1, 2), (2, 1, 2), (3, 1, 3)",
        "rating_detail": "mark_id, key FROM VALUES (1, 'art'), (1, 'art'), (1, 'story')", "user_tag": "user_id, name FROM VALUES (1, 'x'), (1, 'x'), (2, 'x')", "mark_tag": "mark_id, tag_id FROM VALUES (1, 2), (1, 2), (2, 2)",
        "progress": "mark_id, episode_id FROM VALUES (1, 2), (1, 2), (1, 3)", "item": "collection_id, mark_id FROM VALUES (1, 2), (1, 2), (2, 2)", "subject_staff": "subject_id, staff_id, role FROM VALUES (1, 2, ''), (1, 2, ''), (1, 2, 'x')",
        "subject_character": "subject_id, character_id, role FROM VALUES (1, 2, ''), (1, 2, ''), (1, 2, 'x')", "subject_actor": "subject_id, character_id, actor_id FROM VALUES (1, 2, 3), (1, 2, 3), (1, 2, 4)",
        "subject_subject": "source_id, target_id, relation FROM VALUES (1, 2, 'A'), (1, 2, 'A'), (2, 1, 'A')", "calendar_subject": "subject_id FROM VALUES (1), (1), (2)",
        "bookmark": "user_id, post_id, review_id, collection_id FROM VALUES (1, 2, null, null), (1, 2, null, null), (1, null, 3, null), (1, null, 3, null), (1, null, null, 4), (1, null, null, 4), (2, null, null, 4)",
        "activity": "dedupe_key FROM VALUES ('a'), ('a'), (''), (''), (null), (null), ('b')", "follow": "follower_id, following_id FROM VALUES (1, 2), (1, 2), (2, 1)", "block": "user_id, target_id FROM VALUES (1, 2), (1, 2), (2, 1)",
        "mute": "user_id, target_id FROM VALUES (1, 2), (1, 2), (2, 1)", "profile": "user_id, nickname FROM VALUES (1, 'n'), (1, 'm'), (2, 'n')", "name_mapping": "external_name FROM VALUES ('x'), ('x'), ('y')",
    }
    for name, text in texts.items():
        columns, rows = text.split(" FROM ")
        v.made[name] = spark.sql(f"SELECT * FROM {rows} AS x({columns})")
    found = sorted(tuple(r) for r in queries_ingest.audit_unique_keys(v).collect())
    want = {
        "reaction": "1:post:2:like", "mark": "1:2", "rating detail": "1:art", "tag": "1:x", "tag of mark": "1:2", "progress": "1:2", "item": "1:2", "staff": "1:2:", "character": "1:2:", "actor": "1:2:3", "relation": "1:2:A", "calendar": "1",
        "bookmark of post": "1:2", "bookmark of review": "1:3", "bookmark of collection": "1:4", "activity": "a", "follow": "1:2", "block": "1:2", "mute": "1:2", "user of profile": "1", "nickname": "n", "name mapping": "x",
    }
    assert found == sorted(want.items())
