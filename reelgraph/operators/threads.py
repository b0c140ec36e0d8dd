"""Deletes of comments in the order of a list, with all that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def with_ancestors(marked: DataFrame, parents: DataFrame) -> DataFrame:
    """(id): the marked ids and all their ancestors over parents (id, up).

    Each round marks twice as many levels: what a round has marked goes up by a jump, and jumps are joined to jumps of
    double length. A tree d levels deep takes log2(d) rounds. Nothing new in a round means that all is marked, so
    circles end too. Rounds are tables in the shared folder."""
    marked, jumps = stored(marked.select("id").distinct()), stored(parents.select("id", "up"))
    n = marked.count()
    while n:
        reached = jumps.join(marked, "id", "left_semi").select(F.col("up").alias("id"))
        more = stored(marked.unionByName(reached).distinct())
        if (m := more.count()) == n:
            break
        marked, n = more, m
        jumps = stored(jumps.join(jumps.select(F.col("id").alias("up"), F.col("up").alias("further")), "up").select("id", F.col("further").alias("up")))
    return marked


def fates(comments: DataFrame, deletes: DataFrame) -> DataFrame:
    """(id, parent_id, post_id, gone): what becomes of the comments that a delete list (id, number) takes away, in the order
    of `number`: gone for good, or (not gone) a blank that holds its replies.

    Hidden and locked comments can't be deleted, and so not twice either: of several deletes of an id the first counts.
    A comment vanishes if no reply is left when its turn comes: each reply must have vanished before, so all below it must
    be on the list, and each before its parent. Whoever has a reply that breaks this stays, and so do all above it."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in comments.columns else F.lit(False)
    turn = deletes.groupBy("id").agg(F.min("number" if "number" in deletes.columns else F.lit(0)).alias("turn"))
    open_ = comments.where(~flag("is_hidden") & ~flag("is_locked")).select("id", "parent_id", "post_id")
    taken = stored(open_.join(turn, "id"))
    replies = comments.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), F.col("id").alias("reply"))
    replies = replies.join(taken.select("id", "turn"), "id").join(taken.select(F.col("id").alias("reply"), F.col("turn").alias("before")), "reply", "left")
    holding = replies.where(~F.coalesce(F.col("before") < F.col("turn"), F.lit(False))).select("id")
    above = taken.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("up"))
    above = above.join(taken.select(F.col("id").alias("up")), "up", "left_semi")
    kept = with_ancestors(holding, above).withColumn("kept", F.lit(True))
    return taken.join(kept, "id", "left").select("id", "parent_id", "post_id", F.col("kept").isNull().alias("gone"))


def lowered(count: Column, by: Column) -> Column:
    """A count less `by`, not below 0; one that is 0 or below stays."""
    return F.when(count > 0, F.greatest(F.lit(0), count - F.coalesce(by, F.lit(0)))).otherwise(count)


def comment_deletes(comments: DataFrame, deletes: DataFrame, posts: DataFrame | None = None, activities: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Comments, posts and activities after a delete list (id, and `number` for its order; without it all at once).

    Comments that vanish lower the stored reply_count of their parent and post, not below 0, and take their activities
    along; those that hold replies are blanked, hidden and no spoilers, and their activities are hidden. Other counts stay
    as stored. Null ids on the list do nothing; ids that no comment has neither."""
    done = stored(fates(comments, deletes))
    gone = done.where("gone")
    one = lambda rows, key, is_gone, is_kept, lost: rows.select(F.col(key).alias("id"), F.lit(is_gone).alias("gone"), F.lit(is_kept).alias("kept"), F.lit(lost).alias("lost"))
    changes = one(gone, "id", True, False, 0).unionByName(one(done.where("NOT gone"), "id", False, True, 0)).unionByName(one(gone.where("parent_id IS NOT NULL"), "parent_id", False, False, 1))
    changes = changes.groupBy("id").agg(F.bool_or("gone").alias("gone"), F.bool_or("kept").alias("kept"), F.sum("lost").alias("lost"))
    columns = comments.columns
    left = comments.select("id", F.struct(*columns).alias("row")).join(changes, "id", "left").where("NOT coalesce(gone, FALSE)")
    kept = F.coalesce("kept", F.lit(False))
    new = {"content": F.when(kept, F.lit("")).otherwise(F.col("row.content")), "is_hidden": F.coalesce("row.is_hidden", F.lit(False)) | kept, "reply_count": lowered(F.col("row.reply_count"), F.col("lost")).cast(comments.schema["reply_count"].dataType)}
    if "is_spoiler" in columns:
        new["is_spoiler"] = F.col("row.is_spoiler") & ~kept
    out = left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])
    if posts is not None:
        n = gone.where("post_id IS NOT NULL").groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("lost"))
        posts = posts.join(n, "id", "left").withColumn("reply_count", lowered(F.col("reply_count"), F.col("lost")).cast(posts.schema["reply_count"].dataType)).select(*posts.columns)
    if activities is not None:
        fate = done.select(F.col("id").alias("comment_id"), "gone")
        policy = F.when(F.col("gone").isNotNull(), F.lit("hidden")).otherwise(F.col("feed_policy"))
        activities = activities.join(fate, "comment_id", "left").where("NOT coalesce(gone, FALSE)").withColumn("feed_policy", policy).select(*activities.columns)
    return out, posts, activities
