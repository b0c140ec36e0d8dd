"""Marks, tags, progress, reviews, collections and profile statistics, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import down, listed, ordering, placed, up
from ..functions.text import contains
from ..sources.shared import stored
from .catalog import TYPES, scored
from .edges import hidden_authors


#: By what each list can be sorted.
MARK_ORDERS = ("created_at", "updated_at", "simple_rating", "rating", "watch_start_date", "watch_end_date")
PUBLIC_ORDERS = ("id", "simple_rating", "rating", "watch_start_date", "watch_end_date")
REVIEW_ORDERS = ("created_at", "id")
COLLECTION_ORDERS = ("id", "name", "simple_rating", "item_count")


def with_subject(marks: DataFrame, subjects: DataFrame) -> DataFrame:
    s = subjects.select(F.col("id").alias("subject_id"), "title", "title_cn", "subject_type")
    return marks.join(s, "subject_id")


def any_contains(keyword: str, *columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | contains(F.col(c), keyword)
    return out


def library_list(marks: DataFrame, subjects: DataFrame, status: str | None = None, subject_type: str | None = None, tagged: DataFrame | None = None, order: str | list[str] | None = None) -> DataFrame:
    """Own marks of the types that a library lists, with their `place` in their user's list (newest first, if `order` is
    none of MARK_ORDERS; for several orders see `listed`); only those in tagged (mark_id), if given: by semi-join, so that no mark is doubled."""
    rows = with_subject(marks, subjects).where(F.col("subject_type").isin(*TYPES))
    rows = rows if status is None else rows.where(F.col("status") == status)
    rows = rows if subject_type is None else rows.where(F.col("subject_type") == subject_type)
    rows = rows if tagged is None else rows.join(tagged.select(F.col("mark_id").alias("id")), "id", "left_semi")
    return listed(rows, "user_id", order, MARK_ORDERS, "-created_at")


def public_library(marks: DataFrame, subjects: DataFrame, status: str | None = None, keyword: str | None = None, subject_type: str | None = None, order: str | list[str] | None = None) -> DataFrame:
    """Public marks, of all subject types, with their `place` in their user's list (`-id` if `order` is none of
    PUBLIC_ORDERS)."""
    rows = with_subject(marks.where("is_public"), subjects)
    rows = rows if status is None else rows.where(F.col("status") == status)
    rows = rows if subject_type is None else rows.where(F.col("subject_type") == subject_type)
    rows = rows if keyword is None else rows.where(any_contains(keyword, "title", "title_cn", "comment"))
    return listed(rows, "user_id", order, PUBLIC_ORDERS, "-id")


def library_search(marks: DataFrame, subjects: DataFrame, keyword: str, status: str | None = None, subject_type: str | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """Own marks whose subject's titles hold the keyword or are similar to it, with the score and the `place` in their
    user's list, highest scores first; filters as in `library_list`."""
    wanted = subjects.where(F.col("subject_type").isin(*TYPES) if subject_type is None else (F.col("subject_type") == subject_type) & F.col("subject_type").isin(*TYPES))
    found = scored(wanted, keyword).select(F.col("id").alias("subject_id"), "title", "score")
    rows = marks if status is None else marks.where(F.col("status") == status)
    rows = rows if tagged is None else rows.join(tagged.select(F.col("mark_id").alias("id")), "id", "left_semi")
    return placed(rows.join(found, "subject_id"), "user_id", [F.desc("score"), down("created_at"), F.desc("id")])


def local_day(zone: Column, at: Column) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), zone, at))


def local_marks(marks: DataFrame, profiles: DataFrame) -> DataFrame:
    zones = profiles.select("user_id", "zone")
    return marks.join(zones, "user_id").withColumn("day", local_day(F.col("zone"), F.col("created_at")))


def mark_calendar(marks: DataFrame, profiles: DataFrame, year: int) -> DataFrame:
    """Marks per user and day of the year, in the user's own zone."""
    rows = local_marks(marks, profiles).where((F.col("day") >= F.make_date(F.lit(year), F.lit(1), F.lit(1))) & (F.col("day") < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))))
    return rows.groupBy("user_id", "day").agg(F.count("*").alias("marks"))


def available_years(marks: DataFrame, profiles: DataFrame) -> DataFrame:
    return local_marks(marks, profiles).groupBy("user_id").agg(F.sort_array(F.collect_set(F.year("day")), asc=False).alias("years"))


def counted(users: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """users with one count per table of `parts`, each counted by user_id before it is joined; 0 where there is none."""
    out = users
    for name, rows in parts.items():
        out = out.join(rows.groupBy("user_id").agg(F.count("*").alias(name)), "user_id", "left")
    return out.fillna(0, list(parts))


def owned(reviews: DataFrame, marks: DataFrame) -> DataFrame:
    """Reviews with the user, subject and publicity of their mark."""
    return reviews.join(marks.select(F.col("id").alias("mark_id"), "user_id", "subject_id", F.col("is_public").alias("mark_public")), "mark_id")


def profile_counts(users: DataFrame, marks: DataFrame, reviews: DataFrame, collections: DataFrame, follows: DataFrame) -> DataFrame:
    """Public marks, reviews (their marks public too) and collections, following and followers."""
    return counted(
        users,
        {
            "public_marks": marks.where("is_public"), "public_reviews": owned(reviews, marks).where("is_public AND mark_public"), "public_collections": collections.where("is_public"),
            "following": follows.select(F.col("follower_id").alias("user_id")), "followers": follows.select(F.col("following_id").alias("user_id")),
        },
    )


def profile_totals(users: DataFrame, marks: DataFrame, reviews: DataFrame, collections: DataFrame, profiles: DataFrame, year: int) -> DataFrame:
    in_year = local_marks(marks, profiles).where(F.year("day") == year)
    return counted(users, {"marks": marks, "reviews": owned(reviews, marks), "collections": collections, "marks_in_year": in_year})


def progress_summary(marks: DataFrame, episodes: DataFrame, progress: DataFrame) -> DataFrame:
    """Per mark: episodes of the kind EP, all finished rows, and the finished ids in episode order. The episodes are
    counted per subject, not per mark."""
    total = episodes.where("type = 'EP'").groupBy("subject_id").agg(F.count("*").alias("total_episodes"))
    place = F.struct(F.coalesce("sort", F.lit(2**31 - 1)).alias("sort"), F.coalesce("ep_num", F.lit(2**31 - 1)).alias("ep_num"), F.col("id").alias("id"))
    done = progress.where("is_finished").join(episodes.select(F.col("id").alias("episode_id"), place.alias("place")), "episode_id")
    done = done.groupBy(F.col("mark_id").alias("id")).agg(F.count("*").alias("finished_count"), F.transform(F.array_sort(F.collect_list("place")), lambda p: p["id"]).alias("finished_ids"))
    out = marks.select("id", "user_id", "subject_id").join(total, "subject_id", "left").join(done, "id", "left")
    return out.fillna(0, ["total_episodes", "finished_count"]).withColumn("finished_ids", F.coalesce("finished_ids", F.array().cast("array<bigint>")))


def episode_progress(marks: DataFrame, episodes: DataFrame, progress: DataFrame) -> DataFrame:
    """(id, user_id, episode_id, title, type, ep_num, sort, date, is_finished, place): each mark with the episodes of the
    kind EP of its subject in their order, and whether the mark has finished them. Columns that episodes lack are left.

    Episodes get their places once a subject, not once a mark, and a mark carries the ids that it has finished (no more
    than its subject has episodes); so marks meet episodes last, and the pairs are neither shuffled nor sorted."""
    shown = [c for c in ("title", "type", "ep_num", "sort", "date") if c in episodes.columns]
    own = placed(episodes.where("type = 'EP'").select(F.col("id").alias("episode_id"), "subject_id", *shown), "subject_id", [up("sort"), up("ep_num"), F.asc("episode_id")])
    done = progress.where("is_finished").groupBy(F.col("mark_id").alias("id")).agg(F.collect_set("episode_id").alias("finished"))
    rows = marks.select("id", "user_id", "subject_id").join(done, "id", "left").join(own, "subject_id")
    return rows.withColumn("is_finished", F.coalesce(F.array_contains("finished", F.col("episode_id")), F.lit(False))).drop("finished")


def nested(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Child rows of each mark as a sorted array of structs."""
    return rows.groupBy("mark_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def library_cards(marks: DataFrame, mark_tags: DataFrame, tags: DataFrame, details: DataFrame) -> DataFrame:
    """Marks with their tags by (name, id) and rating details in insertion order."""
    named = mark_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    out = marks.withColumnRenamed("id", "mark_id")
    for name, rows, columns in (("tags", named, ("name", "tag_id")), ("details", details, ("id", "key", "value"))):
        child = nested(rows, name, *columns)
        out = out.join(child, "mark_id", "left").withColumn(name, F.coalesce(name, F.array().cast(child.schema[name].dataType)))
    return out.withColumnRenamed("mark_id", "id")


def subject_context(asked: DataFrame, marks: DataFrame, mark_tags: DataFrame, tags: DataFrame, details: DataFrame, reviews: DataFrame, progress: DataFrame) -> DataFrame:
    """asked (user_id, subject_id) with the mark, if there is one, and its tags, details, reviews and finished ids.

    The marks that are asked for are found first, and of all other tables only what is theirs is put together."""
    mine = stored(marks.select("id", "user_id", "subject_id", "status").join(asked.select("user_id", "subject_id"), ["user_id", "subject_id"], "left_semi"))
    ids = mine.select(F.col("id").alias("mark_id"))
    theirs = lambda rows, *columns: rows.select("mark_id", *columns).join(ids, "mark_id", "left_semi")
    cards = library_cards(mine, theirs(mark_tags, "tag_id"), tags, theirs(details, "id", "key", "value")).withColumnRenamed("id", "mark_id")
    cards = cards.join(nested(theirs(reviews, "id"), "reviews", "id"), "mark_id", "left").join(nested(theirs(progress.where("is_finished"), "episode_id"), "finished", "episode_id"), "mark_id", "left")
    out = asked.join(cards, ["user_id", "subject_id"], "left")
    kinds = dict(cards.dtypes)
    for name in ("tags", "details", "reviews", "finished"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kinds[name])))
    return out


def tags_list(mark_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, tag_id, name, uses): the tags of each user with the number of marks."""
    uses = mark_tags.groupBy("tag_id").agg(F.count("*").alias("uses"))
    return tags.select("user_id", F.col("id").alias("tag_id"), "name").join(uses, "tag_id", "left").fillna(0, ["uses"]).orderBy("user_id", "name", "tag_id")


def rating_map(details: DataFrame) -> DataFrame:
    """Rating details of each mark as key → value, in insertion order."""
    rows = details.groupBy("mark_id").agg(F.array_sort(F.collect_list(F.struct("id", "key", "value"))).alias("r"))
    return rows.select("mark_id", F.map_from_entries(F.transform("r", lambda x: F.struct(x["key"], x["value"]))).alias("details"))


def reviews_of(reviews: DataFrame, marks: DataFrame, keyword: str | None = None, public: bool = False) -> DataFrame:
    rows = owned(reviews, marks)
    rows = rows.where("is_public AND mark_public") if public else rows
    return rows if keyword is None else rows.where(any_contains(keyword, "title", "content"))


def reviews_list(reviews: DataFrame, marks: DataFrame, keyword: str | None = None, public: bool = False, order: str | list[str] | None = None) -> DataFrame:
    """Own or public reviews with their `place` in their user's list: newest first, or by `-id` if public, unless `order`
    is one of REVIEW_ORDERS."""
    rows = reviews_of(reviews, marks, keyword, public)
    return listed(rows, "user_id", order, REVIEW_ORDERS, "-id" if public else "-created_at")


def subject_reviews(reviews: DataFrame, marks: DataFrame, viewers: DataFrame, blocks: DataFrame, likes: DataFrame) -> DataFrame:
    """(viewer_id, id, subject_id, likes, place): public reviews each viewer may see, last updated first within a subject; a
    block hides, a mute doesn't.

    Only reviews of subjects in `viewers` (viewer_id, subject_id) are paired with viewers.
    """
    rows = reviews_of(reviews, marks, public=True).join(viewers, "subject_id").withColumnRenamed("user_id", "author_id")
    seen = rows.join(hidden_authors(blocks), ["viewer_id", "author_id"], "left_anti")
    seen = placed(seen, ("viewer_id", "subject_id"), ordering("-updated_at"))
    return seen.join(likes.where("target_type = 'review'").select(F.col("target_id").alias("id"), "likes"), "id", "left").fillna(0, ["likes"])


def collection_counts(collections: DataFrame, items: DataFrame, likes: DataFrame) -> DataFrame:
    """Distinct items and likes of each collection; each side is counted before the join, so none multiplies the other."""
    n = items.groupBy(F.col("collection_id").alias("id")).agg(F.count_distinct(items["id"]).alias("item_count"))
    liked = likes.where("target_type = 'collection'").select(F.col("target_id").alias("id"), F.col("likes").alias("reaction_count"))
    return collections.join(n, "id", "left").join(liked, "id", "left").fillna(0, ["item_count", "reaction_count"])


def collections_list(counted: DataFrame, keyword: str | None = None, public: bool = False, order: str | list[str] | None = None) -> DataFrame:
    """Own or public collections (collection_counts) with their `place` in their user's list: by `id`, or `-id` if public,
    unless `order` is one of COLLECTION_ORDERS. A keyword is looked for in names, in public lists in notes as well."""
    rows = counted.where("is_public") if public else counted
    rows = rows if keyword is None else rows.where(any_contains(keyword, *(("name", "note") if public else ("name",))))
    return listed(rows, "user_id", order, COLLECTION_ORDERS, "-id" if public else "id")


def collection_items(items: DataFrame, marks: DataFrame, subjects: DataFrame, public: bool = False) -> DataFrame:
    """Items with mark and subject and their `position` in the collection, by (place, id); public ones need a public mark."""
    m = marks.where("is_public") if public else marks
    rows = items.join(m.select(F.col("id").alias("mark_id"), "user_id", "subject_id", "status"), "mark_id")
    rows = rows.join(subjects.select(F.col("id").alias("subject_id"), "title"), "subject_id")
    return placed(rows, "collection_id", ordering("place", "id"), "position")
