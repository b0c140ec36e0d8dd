"""Follow, block and mute edges between users, and what they hide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import ordering, placed


def pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.col(a).alias("viewer_id"), F.col(b).alias("author_id"))


def hidden_authors(blocks: DataFrame, mutes: DataFrame | None = None) -> DataFrame:
    """(viewer_id, author_id) that a surface hides: blocked, blocking and, where mutes are given, muted authors. Posts,
    comments and activities hide all three; reviews leave muted ones."""
    out = pairs(blocks, "user_id", "target_id").unionByName(pairs(blocks, "target_id", "user_id"))
    out = out if mutes is None else out.unionByName(pairs(mutes, "user_id", "target_id"))
    return out.distinct()


def blocked_between(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """asked (a, b) with `blocked`: a block in either direction."""
    both = hidden_authors(blocks).select(F.col("viewer_id").alias("a"), F.col("author_id").alias("b"), F.lit(True).alias("blocked"))
    return asked.join(both, ["a", "b"], "left").fillna(False, ["blocked"])


def profile_gate(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """asked (viewer_id, author_id) without profiles blocked either way; one's own is never."""
    hidden = hidden_authors(blocks).where("viewer_id <> author_id")
    return asked.join(hidden, ["viewer_id", "author_id"], "left_anti")


def edge_purge(follows: DataFrame, mutes: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What blocks leave: follows in neither direction, and no mute by the blocker."""
    either = hidden_authors(blocks).select(F.col("viewer_id").alias("follower_id"), F.col("author_id").alias("following_id"))
    return follows.join(either, ["follower_id", "following_id"], "left_anti"), mutes.join(blocks.select("user_id", "target_id"), ["user_id", "target_id"], "left_anti")


def with_profile(edges: DataFrame, user: str, profiles: DataFrame) -> DataFrame:
    """Edges with the nickname of one end; empty without a profile."""
    return edges.join(profiles.select(F.col("user_id").alias(user), "nickname"), user, "left").fillna("", ["nickname"])


def follow_lists(follows: DataFrame, profiles: DataFrame) -> DataFrame:
    """(kind, user_id, other_id, nickname, created_at, place): whom each user follows and by whom each is followed, newest
    first."""
    out = []
    for kind, user, other in (("following", "follower_id", "following_id"), ("follower", "following_id", "follower_id")):
        rows = follows.select(F.lit(kind).alias("kind"), F.col(user).alias("user_id"), F.col(other).alias("other_id"), "created_at")
        out.append(with_profile(placed(rows, "user_id", ordering("-created_at", "-other_id")), "other_id", profiles))
    return out[0].unionByName(out[1])


def block_mute_lists(blocks: DataFrame, mutes: DataFrame, profiles: DataFrame) -> DataFrame:
    """(kind, user_id, other_id, nickname, created_at, place): whom each user blocks and mutes, newest first."""
    one = lambda rows, kind: with_profile(placed(rows.select(F.lit(kind).alias("kind"), "user_id", F.col("target_id").alias("other_id"), "created_at"), "user_id", ordering("-created_at", "-other_id")), "other_id", profiles)
    return one(blocks, "block").unionByName(one(mutes, "mute"))


def follow_stats(follows: DataFrame) -> DataFrame:
    a = follows.groupBy(F.col("follower_id").alias("user_id")).agg(F.count("*").alias("following_count"))
    b = follows.groupBy(F.col("following_id").alias("user_id")).agg(F.count("*").alias("follower_count"))
    return a.join(b, "user_id", "full").fillna(0, ["following_count", "follower_count"])
