"""Posts, comments, targets, activities, feeds, notifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import allowed, listed, ordering, placed
from ..functions.text import contains
from ..sources.shared import stored
from .edges import hidden_authors, pairs

#: Target kinds in the order in which a row's columns are looked at.
KINDS = ("post", "comment", "review", "collection", "activity")
#: The order for notifications.
NOTIFIED = ("activity", "post", "comment", "review", "collection")
PAGE = 16
#: By what each list can be sorted.
ACTIVITY_ORDERS = ("created_at", "id")
POST_ORDERS = ("created_at", "last_activity_at", "reaction_count", "reply_count")


def targets(rows: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds target_type and target_id from the first `<kind>_id` column that is not null."""
    there = [k for k in kinds if f"{k}_id" in rows.columns]
    kind = F.coalesce(*[F.when(F.col(f"{k}_id").isNotNull(), F.lit(k)) for k in there])
    return rows.withColumn("target_type", kind).withColumn("target_id", F.coalesce(*[F.col(f"{k}_id") for k in there]))


def like_counts(reactions: DataFrame) -> DataFrame:
    """Distinct likes per target; other reactions don't count."""
    likes = reactions.where("reaction_type = 'like'").select("target_type", "target_id", "user_id").distinct()
    return likes.groupBy("target_type", "target_id").agg(F.count("*").alias("likes"))


def first_per_key(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The first row of each key stays. min_by keeps one row per key and task before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(*keys, "first.*")


def latest_per_key(rows: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key wins."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def visible_activities(activities: DataFrame, marks: DataFrame, reviews: DataFrame, collections: DataFrame, items: DataFrame) -> DataFrame:
    """Public, not hidden, and every mark, review (with its mark), collection and item (with its collection and mark)
    attached is public or absent. References that are there are joined as (kind, ref, id) alone, all kinds at once; the
    rows themselves are joined once."""
    public = activities.where("visibility = 'public' AND feed_policy <> 'hidden'")
    mark_flags = marks.select("id", "is_public")
    review_flags = reviews.join(mark_flags.select(F.col("id").alias("mark_id"), F.col("is_public").alias("m")), "mark_id", "left").select("id", (F.col("is_public") & F.coalesce("m", F.lit(True))).alias("is_public"))
    item_flags = items.join(mark_flags.select(F.col("id").alias("mark_id"), F.col("is_public").alias("m")), "mark_id", "left").join(
        collections.select(F.col("id").alias("collection_id"), F.col("is_public").alias("c")), "collection_id", "left"
    )
    item_flags = item_flags.select("id", (F.coalesce("m", F.lit(True)) & F.coalesce("c", F.lit(True))).alias("is_public"))
    sides = {"mark_id": mark_flags, "review_id": review_flags, "collection_id": collections.select("id", "is_public"), "item_id": item_flags}
    private = None
    for key, side in sides.items():
        some = side.where("NOT is_public").select(F.lit(key).alias("kind"), F.col("id").alias("ref"))
        private = some if private is None else private.unionByName(some)
    refs = public.select("id", F.explode(F.filter(F.array(*[F.struct(F.lit(key).alias("kind"), F.col(key).cast("long").alias("ref")) for key in sides]), lambda x: x["ref"].isNotNull())).alias("x"))
    hidden = refs.select("id", "x.kind", "x.ref").join(private, ["kind", "ref"], "left_semi").select("id").distinct()
    return public.join(hidden, "id", "left_anti")


def visible_among(mine: DataFrame, marks: DataFrame, reviews: DataFrame, collections: DataFrame, items: DataFrame) -> DataFrame:
    """As `visible_activities`, for activities that are kept and may be read several times: of the other tables only what
    these refer to is looked at, and that is read once."""
    part = lambda rows, *keys: rows.join(reduce(DataFrame.unionByName, [some.where(F.col(k).isNotNull()).select(F.col(k).cast("long").alias("id")) for some, k in keys]).distinct(), "id", "left_semi")
    r = stored(part(reviews.select("id", "mark_id", "is_public"), (mine, "review_id")))
    i = stored(part(items.select("id", "collection_id", "mark_id"), (mine, "item_id")))
    m = stored(part(marks.select("id", "is_public"), (mine, "mark_id"), (r, "mark_id"), (i, "mark_id")))
    c = stored(part(collections.select("id", "is_public"), (mine, "collection_id"), (i, "collection_id")))
    return visible_activities(mine, m, r, c, i)


def touched_activities(activities: DataFrame, changed: dict[str, DataFrame], reviews: DataFrame, items: DataFrame) -> DataFrame:
    """(id): activities whose visibility may follow from changed rows. changed: for mark, review, collection, item or
    activity the ids (id) that were added, altered or deleted. References are gone back over: from a mark or collection to
    the reviews and items that hang on it, from all of these to the activities that show them."""
    ids = {kind: rows.select("id").distinct() for kind, rows in changed.items()}
    via = lambda rows, key, kind: rows.join(ids[kind].select(F.col("id").alias(key)), key, "left_semi").select("id")
    reached = {kind: [rows] for kind, rows in ids.items()}
    for rows, kind, keys in ((reviews, "review", ("mark",)), (items, "item", ("mark", "collection"))):
        for parent in keys:
            if parent in ids:
                reached.setdefault(kind, []).append(via(rows, f"{parent}_id", parent))
    refs = [rows.select(F.lit(f"{kind}_id").alias("kind"), F.col("id").alias("ref")) for kind, some in reached.items() for rows in some if kind != "activity"]
    found = [ids["activity"]] if "activity" in ids else []
    if refs:
        shown = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("ref")) for k in ("mark_id", "review_id", "collection_id", "item_id")]), lambda x: x["ref"].isNotNull()))
        found.append(activities.select("id", shown.alias("x")).select("id", "x.*").join(reduce(DataFrame.unionByName, refs).distinct(), ["kind", "ref"], "left_semi").select("id"))
    return reduce(DataFrame.unionByName, found).distinct() if found else activities.select("id").limit(0)


def visible_changes(seen: DataFrame, activities: DataFrame, changed: dict[str, DataFrame], marks: DataFrame, reviews: DataFrame, collections: DataFrame, items: DataFrame) -> DataFrame:
    """(id, change): what is to be added to and deleted from the visible ids `seen` after rows have changed; tables are as
    they are now, changed as for `touched_activities`. Only the touched activities are looked at, and of the other tables
    only what these refer to. Both lists of ids are made once, whatever the change set is read for."""
    touched = stored(touched_activities(activities, changed, reviews, items))
    mine = stored(activities.join(touched, "id", "left_semi"))
    now = stored(visible_among(mine, marks, reviews, collections, items).select("id"))
    before = stored(seen.join(touched, "id", "left_semi").select("id"))
    return now.join(before, "id", "left_anti").withColumn("change", F.lit("add")).unionByName(before.join(now, "id", "left_anti").withColumn("change", F.lit("delete")))


def with_changes(seen: DataFrame, change_set: DataFrame) -> DataFrame:
    """The visible ids after a change set."""
    return seen.join(change_set.where("change = 'delete'"), "id", "left_anti").select("id").unionByName(change_set.where("change = 'add'").select("id"))


def following_edges(follows: DataFrame, blocks: DataFrame, mutes: DataFrame, include_self: DataFrame | None = None) -> DataFrame:
    """(viewer_id, author_id) of whom a viewer sees: followed, not hidden, and oneself if `include_self` (user_id) is given."""
    edges = pairs(follows, "follower_id", "following_id").join(hidden_authors(blocks, mutes), ["viewer_id", "author_id"], "left_anti")
    return edges if include_self is None else edges.unionByName(include_self.select(F.col("user_id").alias("viewer_id"), F.col("user_id").alias("author_id"))).distinct()


#: Followers of an author that meet that author's rows in one place; those of an author with more are dealt to several.
FAN_OUT = 100_000


def fan_out(edges: DataFrame, rows: DataFrame, limit: int = FAN_OUT) -> DataFrame:
    """edges (viewer_id, author_id) joined with rows (author_id, ...). An author whom more than `limit` follow is cut into
    slices: viewers go to one each, the author's rows to all. So no task has more than some `limit` edges of an author."""
    hot = edges.groupBy("author_id").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    hot = hot.select("author_id", F.ceil(F.col("n") / limit).cast("int").alias("slices"))
    slice_ = F.pmod(F.xxhash64("viewer_id"), F.col("slices")).cast("int")
    dealt = edges.join(hot, "author_id", "left").select(*edges.columns, F.coalesce(slice_, F.lit(0)).alias("slice"))
    copies = rows.join(hot, "author_id", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    return dealt.join(copies, ["author_id", "slice"]).drop("slice")


def following_feed(visible: DataFrame, edges: DataFrame, since: Column | None = None, limit: int = FAN_OUT) -> DataFrame:
    """Every visible activity, or those from `since` on, of every author a viewer sees: one row an edge and activity, so
    give a time where a first page (`feed_top_k`) does not do."""
    visible = visible if since is None else visible.where(F.col("created_at") >= since)
    return fan_out(edges, visible.withColumnRenamed("user_id", "author_id"), limit)


def feed_order(order: str | None) -> list[Column]:
    """A feed's order by name; newest first, if it is none of ACTIVITY_ORDERS."""
    return ordering(allowed(order, ACTIVITY_ORDERS, "-created_at"))


def top(rows: DataFrame, by: str, k: int, name: str = "rank", order: str | None = None) -> DataFrame:
    return placed(rows, by, feed_order(order), name).where(F.col(name) <= k)


def feed_top_k(visible: DataFrame, edges: DataFrame, k: int = PAGE, order: str | None = None, limit: int = FAN_OUT) -> DataFrame:
    """First page of each viewer's feed. An author's first k are enough for any viewer, so they are cut before the fan-out,
    which then has at most k rows an edge."""
    first = top(visible.withColumnRenamed("user_id", "author_id"), "author_id", k, "place", order).drop("place")
    return top(fan_out(edges, first, limit), "viewer_id", k, order=order)


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the place of each row in the whole order, from 1. Rows are dealt by ranges and numbered within; what comes
    before a range is summed over the ranges, of which there are as many as partitions."""
    dealt = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    kept = stored(dealt)
    counts = kept.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = kept.withColumn("inside", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    return inside.join(F.broadcast(before), "range").withColumn(name, F.col("before") + F.col("inside")).drop("range", "before", "inside")


#: Rows of the ranked whole that all viewers look at in a round, at most.
ROUND = 4096


def global_feed(visible: DataFrame, viewers: DataFrame, hidden: DataFrame, k: int = PAGE, order: str | None = None, most: int = ROUND) -> DataFrame:
    """First page of all visible activities for each viewer (viewer_id), less hidden authors'.

    No page holds more than an author's first k, so only these are ranked. The ranking is read in rounds: the first 4 k
    rows, then eight times as many in each round, `most` at most. A round's rows go to all tasks as one list, of which a
    viewer takes what the own hidden authors leave; whoever still lacks rows goes on to the next round. Viewers aren't
    joined by position, so no key holds all of them, and a row holds no more than a round."""
    first = top(visible.withColumnRenamed("user_id", "author_id"), "author_id", k, "place", order).drop("place")
    head = stored(positions(first, feed_order(order)))
    columns = [c for c in head.columns if c != "position"]
    total, done, size = head.count(), 0, 4 * k
    lacking = viewers.select("viewer_id", F.lit(k).alias("lacks"))
    out: list[DataFrame] = []
    while done < total or not out:
        some = head.where((F.col("position") > done) & (F.col("position") <= done + size))
        # One row, no longer than a round.
        ranked = some.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*columns).alias("row")))), lambda x: x["row"]).alias("ranked")).withColumn("round", F.lit(0))
        mine = hidden.join(F.broadcast(some.select("author_id").distinct()), "author_id", "left_semi").groupBy("viewer_id").agg(F.collect_set("author_id").alias("hides"))
        seen = lacking.join(mine, "viewer_id", "left").withColumn("round", F.lit(0)).join(F.broadcast(ranked), "round")
        left = F.when(F.col("hides").isNull(), F.slice("ranked", 1, F.col("lacks"))).otherwise(F.slice(F.filter("ranked", lambda x: ~F.array_contains("hides", x["author_id"])), 1, F.col("lacks")))
        got = stored(seen.select("viewer_id", "lacks", left.alias("page")))
        rank = F.lit(k) - F.col("lacks") + F.col("pos") + 1
        out.append(got.select("viewer_id", "lacks", F.posexplode("page")).select("viewer_id", rank.cast("int").alias("rank"), "col.*"))
        done, size = done + size, min(most, 8 * size)
        lacking = got.select("viewer_id", (F.col("lacks") - F.size("page")).alias("lacks")).where("lacks > 0")
        if lacking.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def user_activities(activities: DataFrame, visible: DataFrame | None = None, activity_type: str | None = None, order: str | list[str] | None = None) -> DataFrame:
    """Own activities (all), or the visible ones if they are given, with their `place` in their user's list: newest first
    if `order` is none of ACTIVITY_ORDERS."""
    rows = activities if visible is None else visible
    rows = rows if activity_type is None else rows.where(F.col("activity_type") == activity_type)
    return listed(rows, "user_id", order, ACTIVITY_ORDERS, "-created_at")


def posts_public(posts: DataFrame, keyword: str | None = None, subject_id: int | None = None) -> DataFrame:
    rows = posts.where("visibility = 'public' AND feed_policy <> 'hidden'")
    rows = rows if subject_id is None else rows.where(F.col("subject_id") == subject_id)
    return rows if keyword is None else rows.where(contains(F.col("content"), keyword))


def posts_list(posts: DataFrame, viewers: DataFrame, hidden: DataFrame, key: str = "subject_id", keyword: str | None = None, order: str | list[str] | None = None) -> DataFrame:
    """Public posts of the key each viewer asks for, less hidden authors', with their `place` in the viewer's list: by last
    activity, newest first and those without any last, if `order` is none of POST_ORDERS."""
    rows = for_viewers(posts_public(posts, keyword), viewers, hidden, key)
    return listed(rows, "viewer_id", order, POST_ORDERS, "-last_activity_at", ("last_activity_at",))


def comments_public(comments: DataFrame) -> DataFrame:
    """Public comments, hidden ones only while they have replies and with their author masked."""
    rows = comments.where("visibility = 'public' AND (NOT is_hidden OR reply_count > 0)")
    return rows.withColumn("shown_author", F.when(~F.col("is_hidden"), F.col("author_id")))


def comments_list(comments: DataFrame, viewers: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """Public comments of the target (`key`) each viewer looks at, less hidden authors', oldest first: `place` is that in the
    target's list as the viewer sees it."""
    return placed(for_viewers(comments_public(comments), viewers, hidden, key), ("viewer_id", key), ordering("created_at", "id"))


def for_viewers(rows: DataFrame, viewers: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """Rows per viewer who asks for a key (viewers: viewer_id and `key`), less hidden authors'."""
    return viewers.join(rows, key).join(hidden, ["viewer_id", "author_id"], "left_anti")


def viewer_state(shown: DataFrame, reactions: DataFrame, bookmarks: DataFrame, follows: DataFrame) -> DataFrame:
    """shown (viewer_id, target_type, target_id, author_id) with has_liked, has_bookmarked and is_following."""
    key = ["viewer_id", "target_type", "target_id"]
    liked = reactions.where("reaction_type = 'like'").select(F.col("user_id").alias("viewer_id"), "target_type", "target_id").distinct().withColumn("has_liked", F.lit(True))
    marked = targets(bookmarks).select(F.col("user_id").alias("viewer_id"), "target_type", "target_id").distinct().withColumn("has_bookmarked", F.lit(True))
    following = pairs(follows, "follower_id", "following_id").distinct().withColumn("is_following", F.lit(True))
    out = shown.join(liked, key, "left").join(marked, key, "left").join(following, ["viewer_id", "author_id"], "left")
    return out.fillna(False, ["has_liked", "has_bookmarked", "is_following"])


def public_targets(posts: DataFrame, comments: DataFrame, reviews: DataFrame, marks: DataFrame, collections: DataFrame, visible: DataFrame) -> DataFrame:
    """(target_type, target_id, owner_id) of all that can be reached publicly. A comment need only be public and not hidden
    itself, whatever it is on."""
    one = lambda rows, kind, owner: rows.select(F.lit(kind).alias("target_type"), F.col("id").alias("target_id"), F.col(owner).alias("owner_id"))
    open_posts = posts_public(posts)
    open_comments = comments.where("visibility = 'public' AND NOT is_hidden")
    m = marks.where("is_public").select(F.col("id").alias("mark_id"), F.col("user_id").alias("owner"))
    open_reviews = reviews.where("is_public").join(m, "mark_id")
    out = one(open_posts, "post", "author_id")
    for rows, kind, owner in ((open_comments, "comment", "author_id"), (open_reviews, "review", "owner"), (collections.where("is_public"), "collection", "user_id"), (visible, "activity", "user_id")):
        out = out.unionByName(one(rows, kind, owner))
    return out


def target_owners(posts: DataFrame, comments: DataFrame, reviews: DataFrame, marks: DataFrame, collections: DataFrame, activities: DataFrame) -> DataFrame:
    """(target_type, target_id, owner_id) of all targets, public or not."""
    own = reviews.join(marks.select(F.col("id").alias("mark_id"), "user_id"), "mark_id")
    out = None
    for rows, kind, owner in ((posts, "post", "author_id"), (comments, "comment", "author_id"), (own, "review", "user_id"), (collections, "collection", "user_id"), (activities, "activity", "user_id")):
        some = rows.select(F.lit(kind).alias("target_type"), F.col("id").alias("target_id"), F.col(owner).alias("owner_id"))
        out = some if out is None else out.unionByName(some)
    return out


def bookmarks_list(bookmarks: DataFrame, posts: DataFrame, reviews: DataFrame, collections: DataFrame, marks: DataFrame, subjects: DataFrame, keyword: str | None = None, target_type: str | None = None) -> DataFrame:
    """Bookmarks, newest first (`place` in their user's list), with title, body and author of what they point at: a post's
    first line (96 characters), a review's text or a collection's note (240). A keyword is looked for in these and in
    the titles of a post's or review's subject."""
    s = subjects.select(F.col("id").alias("subject_id"), F.col("title").alias("s1"), F.col("title_cn").alias("s2"))
    line = F.substring(F.coalesce(F.element_at(F.split("content", r"\R"), 1), F.lit("")), 1, 96)
    p = posts.join(s, "subject_id", "left").select(F.lit("post").alias("target_type"), F.col("id").alias("target_id"), line.alias("title"), F.col("content").alias("body"), F.array("content", "s1", "s2").alias("searched"))
    r = reviews.join(marks.select(F.col("id").alias("mark_id"), "subject_id"), "mark_id", "left").join(s, "subject_id", "left")
    r = r.select(F.lit("review").alias("target_type"), F.col("id").alias("target_id"), "title", F.substring("content", 1, 240).alias("body"), F.array("title", "content", "s1", "s2").alias("searched"))
    c = collections.select(F.lit("collection").alias("target_type"), F.col("id").alias("target_id"), F.col("name").alias("title"), F.substring("note", 1, 240).alias("body"), F.array("name", "note").alias("searched"))
    rows = targets(bookmarks)
    rows = rows if target_type is None else rows.where(F.col("target_type") == target_type)
    rows = rows.join(p.unionByName(r).unionByName(c), ["target_type", "target_id"], "left")
    rows = rows if keyword is None else rows.where(F.exists("searched", lambda x: contains(x, keyword)))
    return placed(rows.drop("searched"), "user_id", ordering("-created_at"))


def activity_cards(activities: DataFrame, marks: DataFrame, items: DataFrame, reviews: DataFrame, posts: DataFrame, subjects: DataFrame) -> DataFrame:
    """Activities with one subject: their own, else the mark's, the item's mark's, the review's mark's, the post's."""
    m = marks.select(F.col("id").alias("mark_id"), F.col("subject_id").alias("s"))
    of_mark = lambda rows, key, name: rows.select(F.col("id").alias(key), "mark_id").join(m, "mark_id").select(key, F.col("s").alias(name))
    out = activities.join(m.select("mark_id", F.col("s").alias("s1")), "mark_id", "left").join(of_mark(items, "item_id", "s2"), "item_id", "left").join(of_mark(reviews, "review_id", "s3"), "review_id", "left")
    out = out.join(posts.select(F.col("id").alias("post_id"), F.col("subject_id").alias("s4")), "post_id", "left")
    out = out.withColumn("card_subject", F.coalesce("subject_id", "s1", "s2", "s3", "s4")).drop("s1", "s2", "s3", "s4")
    return out.join(subjects.select(F.col("id").alias("card_subject"), F.col("title").alias("subject_title")), "card_subject", "left")


def recount_reactions(rows: DataFrame, reactions: DataFrame, kind: str) -> DataFrame:
    """(id, stored, counted, drift): all reaction types count."""
    n = reactions.where(F.col("target_type") == kind).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("counted"))
    out = rows.select("id", F.col("reaction_count").alias("stored")).join(n, "id", "left").fillna(0, ["counted"])
    return out.withColumn("drift", F.col("stored") - F.col("counted"))


def recount_replies(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(kind, id, stored, counted, drift) of posts (all their comments) and comments (direct replies)."""
    out = None
    for kind, rows, key in (("post", posts, "post_id"), ("comment", comments, "parent_id")):
        n = comments.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("counted"))
        some = rows.select(F.lit(kind).alias("kind"), "id", F.col("reply_count").cast("long").alias("stored")).join(n, "id", "left").fillna(0, ["counted"])
        some = some.select("kind", "id", "stored", "counted", (F.col("stored") - F.col("counted")).alias("drift"))
        out = some if out is None else out.unionByName(some)
    return out


def last_activity(posts: DataFrame, comments: DataFrame, at: str = "created_minute") -> DataFrame:
    """(id, last): the newest of a post's own and its comments' times."""
    newest = comments.groupBy(F.col("post_id").alias("id")).agg(F.max(at).alias("c"))
    return posts.select("id", at).join(newest, "id", "left").select("id", F.greatest(at, "c").alias("last"))


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("recipient_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def notifications_list(notifications: DataFrame, is_read: bool | None = None) -> DataFrame:
    """Notifications with their target, newest first: `place` in the recipient's list of all, read or unread ones."""
    rows = targets(notifications, NOTIFIED)
    rows = rows if is_read is None else rows.where(F.col("read_at").isNotNull() if is_read else F.col("read_at").isNull())
    return placed(rows, "recipient_id", ordering("-created_at"))


def reports_list(reports: DataFrame, status: str | None = None, by_reporter: bool = False) -> DataFrame:
    """Reports, newest first: the staff's queue, or, `by_reporter`, with the `place` in each reporter's own list."""
    rows = reports if status is None else reports.where(F.col("status") == status)
    return placed(rows, "reporter_id", ordering("-created_at")) if by_reporter else rows.orderBy(*ordering("-created_at"))
