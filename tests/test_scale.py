"""What plans must not do at size, on small fixtures."""

import time

from reelgraph.operators import ingest
from reelgraph.sources import tables
from reelgraph.sources.shared import spread


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_payload_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"id": 1, "name": " a ", "airdate": "2001-02-03"}',), (" [1]",), ("{",), (' \n{"id": 0}',)], "value string")
    rows = tables.parsed(lines, "episode")
    good, bad = tables.quarantined(rows)
    assert [r["rejected"] for r in rows.select("rejected").collect()] == [None, "not an object", "not JSON", "no id"]
    mapped = ingest.map_episodes(good)
    assert [(r["title"], str(r["date"])) for r in mapped.collect()] == [("a", "2001-02-03")] and bad.count() == 3
    assert plan(mapped).lower().count("parse_json") + plan(mapped).count("parseJson") == 1


def test_a_small_table_is_dealt_to_all_tasks(spark):
    assert spread(spark.range(1000).coalesce(1), "id").rdd.getNumPartitions() == 4


def test_events_are_not_paired_with_all_orders(spark):
    from reelgraph.plans.fixture_views import Views

    from .conftest import DATA

    asked = Views(spark, DATA).activity.where("subject_id IS NOT NULL").select("user_id", "subject_id").distinct()
    # The one that is left gives each event the number of orders, which is one row.
    assert asked._jdf.queryExecution().executedPlan().toString().count("NestedLoopJoin") == 1


def test_shuffles_grow_with_the_input(spark):
    from reelgraph.plans.fixture_views import DEALT, Views

    from .conftest import DATA

    names = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[1], "20000")
        spark.conf.set(names[2], "1")
        splits = Views(spark, DATA).lineitem.rdd.getNumPartitions()
        assert splits > 1 and int(spark.conf.get(names[0])) >= DEALT * splits
    finally:
        for n, value in old.items():
            spark.conf.set(n, value)


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshots_meet_the_texts_of_subjects_last(spark):
    from reelgraph.operators import derive
    from reelgraph.plans.fixture_views import Views

    from .conftest import DATA

    v = Views(spark, DATA)
    rows = derive.derive_activities(v.mark, v.review, v.collection, v.item, v.post, v.comment, v.follow, v.subject)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree = rows._jdf.queryExecution().optimizedPlan().toString().split("Union", 1)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Above a join by mark there is the one by subject, below it none.
    for part in tree.split("review_created AS activity_type")[1:]:
        lines = [line for line in part.splitlines() if "Join Inner" in line][:2]
        assert "subject_id" in lines[0] and "mark_id" in lines[1]


def test_places_of_episodes_are_made_once_a_subject(spark):
    from reelgraph.operators import library

    marks = spark.createDataFrame([(1, 5, 10), (2, 6, 10), (3, 5, 11), (4, 5, 12)], "id long, user_id long, subject_id long")
    episodes = spark.createDataFrame([(100, 10, "EP", 2, 1), (101, 10, "EP", 1, None), (102, 10, "EP", 1, 9), (103, 10, "SP", 0, 0), (110, 11, "EP", None, None)], "id long, subject_id long, type string, sort int, ep_num int")
    progress = spark.createDataFrame([(1, 100, True), (1, 100, True), (1, 101, False), (2, None, True), (3, 110, True), (None, 110, True), (3, 100, True)], "mark_id long, episode_id long, is_finished boolean")
    rows = library.episode_progress(marks, episodes, progress)
    want = {(1, 102, 1, False), (1, 101, 2, False), (1, 100, 3, True), (2, 102, 1, False), (2, 101, 2, False), (2, 100, 3, False), (3, 110, 1, True)}
    assert {tuple(r) for r in rows.select("id", "episode_id", "place", "is_finished").collect()} == want
    windows = [line for line in plan(rows).splitlines() if "Window [row_number()" in line]
    assert len(windows) == 1 and "windowspecdefinition(subject_id#" in windows[0]


def test_titles_are_never_sent_to_all_tasks(spark):
    from reelgraph.operators import catalog

    subjects = spark.createDataFrame([(1, "red widget", "")], "id long, title string, title_cn string")
    keys = spark.createDataFrame([("red",), ("t",)], "keyword string")
    text = joins(catalog.searched(subjects, keys, 0.15))
    assert "BroadcastHashJoin" in text and "BuildLeft" not in text and "BroadcastHashJoin [id" not in text
    several = spark.createDataFrame([(1, "red widget", ""), (2, "red widget", ""), (3, "red widget", None), (4, "blue", None), (5, None, None)], "id long, title string, title_cn string")
    assert {(r["keyword"], r["id"]) for r in catalog.search_many(several, keys).collect()} == {(k, i) for k in ("red", "t") for i in (1, 2, 3)}


def test_members_are_looked_up_by_their_owners(spark):
    from reelgraph.operators import audit

    asked = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 10), (3, 10), (None, 10), (1, 99), (1, None), (4, 12), (4, 12), (4, 12)], "m long, e long")
    parents = spark.createDataFrame([(1, 7), (2, 8), (4, None)], "m long, s long")
    members = spark.createDataFrame([(10, 7), (11, 7), (12, None)], "e long, s long")
    rows = audit.invalid_members(asked, parents, members, "m", "e", "s")
    want = [(1, 10, "repeated"), (1, 99, "unknown"), (1, None, "unknown"), (2, 10, "unknown"), (3, 10, "unknown"), (4, 12, "repeated"), (4, 12, "unknown"), (None, 10, "unknown")]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)


def test_folded_marks_are_read_twice_and_made_once(spark):
    from reelgraph.operators import derive

    marks = spark.createDataFrame([(1, "a", True), (2, "b", True)], "id long, status string, is_public boolean")
    patches = spark.createDataFrame([(1, 2, ["status"], "y", None), (1, 1, ["status", "is_public"], "x", False)], "id long, number int, fields array<string>, status string, is_public boolean")
    out, done = derive.patch_marks(marks, patches)
    assert {tuple(r) for r in out.collect()} == {(1, "y", False), (2, "b", True)} and sorted(map(tuple, done.collect())) == [(1, 1), (1, 2)]
    assert "Join" not in plan(out) and "Join" not in plan(done)


def test_a_delta_of_visible_ids_makes_its_views_once(spark):
    from reelgraph import catalogue

    from .conftest import DATA

    out = catalogue.queries()["activity_public_delta"](spark, DATA)
    # Each view is written once; what is read after that are the written ones.
    assert not [f for f in out.inputFiles() if f.startswith(f"file://{DATA}")]


def test_what_a_stored_table_shuffled_is_freed(spark):
    from pyspark.sql import functions as F
    from reelgraph.sources.shared import stored

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}
    before, grouped = shuffled(), spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    rows = stored(grouped)
    for _ in range(100):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    # Other queries keep theirs.
    assert rows.count() == grouped.count() == 10 and not shuffled() <= before


def test_marks_are_shuffled_once_for_all_that_is_done_with_them(spark):
    from reelgraph.operators import derive
    from reelgraph.plans.fixture_views import Views

    from .conftest import DATA

    v = Views(spark, DATA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = joins(derive.derive_activities(v.mark, v.review, v.collection, v.item, v.post, v.comment, v.follow, v.subject, v.mark.select("id")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Marks with what is done with them, and the subjects.
    assert text.count("Exchange hashpartitioning(subject_id") == 2 and "hashpartitioning(mark_id" not in text


def test_what_is_done_with_marks_keeps_repeated_and_odd_rows(spark):
    import json

    from reelgraph.operators import derive

    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    marks = table([(1, 5, 10, True), (2, 5, None, True), (3, 6, 11, False), (3, 7, 11, True), (4, 5, 99, True), (5, None, 10, None)], "id long, user_id long, subject_id long, is_public boolean").selectExpr("*", "7.25D AS rating")
    reviews = table([(21, 1, None, True), (22, 1, "t", False), (23, 3, "u", True), (24, 8, "v", True), (25, None, "w", True)], "id long, mark_id long, title string, is_public boolean")
    collections = table([(70, 9, "c", True), (71, 9, None, False)], "id long, user_id long, name string, is_public boolean")
    items = table([(700, 70, 1, 0, "x"), (701, 71, 1, 1, None), (702, 72, 1, 2, None), (703, 70, 2, 3, None), (704, 70, 5, 4, None)], "id long, collection_id long, mark_id long, place int, relation string")
    subjects = table([(10, "ten"), (11, None)], "id long, title string").selectExpr("*", "'' AS subject_type", "'' AS title_cn", "DATE '2001-02-03' AS date", "'' AS platform", "false AS nsfw")
    posts, comments, follows = table([], "id long, author_id long, visibility string"), table([], "id long, author_id long, visibility string, post_id long"), table([], "follower_id long, following_id long")
    updates = table([(1,), (1,), (3,), (8,), (None,)], "id long")
    found = derive.derive_activities(marks, reviews, collections, items, posts, comments, follows, subjects, updates).where("activity_type <> 'collection_created'").collect()
    shown = sorted((r["activity_type"], r["user_id"] or 0, r["source_id"] or 0, r["subject_id"], r["message"], r["visibility"], r["dedupe_key"]) for r in found)
    who = ((6, "private"), (7, "public"))
    assert shown == sorted(
        [("user_subject_created", 5, 1, 10, "Added 'ten' to collection", "public", "user_subject_created:1"), ("user_subject_created", 0, 5, 10, "Added 'ten' to collection", "private", "user_subject_created:5")]
        + [("user_subject_created", u, 3, 11, "Added '' to collection", seen, "user_subject_created:3") for u, seen in who] + [("user_subject_updated", u, 3, 11, "Updated collection status for ''", seen, "") for u, seen in who]
        + 2 * [("user_subject_updated", 5, 1, 10, "Updated collection status for 'ten'", "public", "")]
        + [("review_created", 5, 21, 10, "Posted a review for 'ten': ", "public", "review_created:21"), ("review_created", 5, 22, 10, "Posted a review for 'ten': t", "private", "review_created:22")]
        + [("review_created", u, 23, 11, "Posted a review for '': u", seen, "review_created:23") for u, seen in who]
        + [("collection_item_added", 9, 700, 10, "Added 'ten' to collection 'c'", "public", "collection_item_added:700"), ("collection_item_added", 9, 701, 10, "Added 'ten' to collection ''", "private", "collection_item_added:701"), ("collection_item_added", 9, 704, 10, "Added 'ten' to collection 'c'", "private", "collection_item_added:704")]
    )
    data = {r["dedupe_key"]: json.loads(r["metadata"]) for r in found}
    assert data["review_created:22"]["review"] == {"id": 22, "title": "t"} and set(data["user_subject_created:1"]) == {"subject", "user_subject"}
    assert data["user_subject_created:1"]["user_subject"] == {"id": 1, "status": None, "simple_rating": None, "rating": "7.3", "comment": None, "is_public": True}
    assert data["collection_item_added:700"]["collection_item"] == {"id": 700, "relation": "x", "order": 0} and data["collection_item_added:701"]["collection"] == {"id": 71, "name": None}


def test_a_context_is_made_of_the_marks_that_are_asked_for(spark):
    from reelgraph.plans import queries_library
    from reelgraph.plans.fixture_views import Views

    from .conftest import DATA

    all_, v = Views(spark, DATA), Views(spark, DATA)
    queries_library.subject_context(v)
    asked = all_.activity.where("subject_id IS NOT NULL").select("user_id", "subject_id")
    wanted = {r["id"] for r in all_.mark.join(asked, ["user_id", "subject_id"], "left_semi").select("id").collect()}
    assert {r["id"] for r in v.mark.select("id").collect()} == wanted and 0 < len(wanted) < all_.mark.count() / 2


def test_a_context_keeps_repeated_and_odd_rows(spark):
    from reelgraph.operators import library

    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = table([(1, 10), (1, 11), (2, 10), (2, 10), (None, 10), (3, None)], "user_id long, subject_id long")
    marks = table([(100, 1, 10, "done"), (101, 2, 10, "wish"), (102, 2, 11, "done"), (103, None, 10, "done"), (None, 1, 11, "done")], "id long, user_id long, subject_id long, status string")
    tags, mark_tags = table([(5, "b"), (6, "a"), (7, "c")], "id long, name string"), table([(100, 5), (100, 6), (102, 7), (None, 7), (101, 9)], "mark_id long, tag_id long")
    details, reviews = table([(2, 100, "x", 1.0), (1, 100, "y", 2.0), (3, 102, "x", 1.0)], "id long, mark_id long, key string, value double"), table([(8, 101), (9, 101), (10, 102)], "id long, mark_id long")
    progress = table([(100, 1, True), (100, 2, False), (101, 3, True), (102, 4, True), (None, 5, True)], "mark_id long, episode_id long, is_finished boolean")
    rows = library.subject_context(asked, marks, mark_tags, tags, details, reviews, progress)
    found = [(r["user_id"], r["subject_id"], r["mark_id"], r["status"], [t["name"] for t in r["tags"]], [d["key"] for d in r["details"]], [x["id"] for x in r["reviews"]], [e["episode_id"] for e in r["finished"]]) for r in rows.collect()]
    none = (None, None, [], [], [], [])
    want = [(1, 10, 100, "done", ["a", "b"], ["y", "x"], [], [1]), (1, 11, None, "done", [], [], [], []), (2, 10, 101, "wish", [], [], [8, 9], [3]), (2, 10, 101, "wish", [], [], [8, 9], [3]), (None, 10, *none), (3, None, *none)]
    assert sorted(found, key=str) == sorted(want, key=str)
