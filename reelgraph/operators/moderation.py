"""Moderators' actions and resolved reports as one set of changes (table, id, column, value), folded once and laid on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .community import targets

#: What can be acted on, by the kind of target; hide reaches posts, comments and activities, lock the first two.
TARGETS = ("post", "comment", "activity", "review", "collection")
EFFECTS = {("post", "hide"): ("feed_policy", "hidden"), ("comment", "hide"): ("is_hidden", "true"), ("activity", "hide"): ("feed_policy", "hidden"), ("post", "lock"): ("is_locked", "true"), ("comment", "lock"): ("is_locked", "true")}
CHANGE = ["table", "id", "column", "value"]


def changes(actions: DataFrame, activities: DataFrame) -> DataFrame:
    """The change set of actions (target_type, target_id, action_type): each (table, id, column) once.

    Hiding a post or comment also hides the activities (id, post_id, comment_id) that show it. Other kinds and types of
    action change nothing. All values only ever set a flag, so neither order nor repeats count."""
    effect = F.create_map(*[x for key, (column, value) in EFFECTS.items() for x in (F.lit(":".join(key)), F.struct(F.lit(column).alias("column"), F.lit(value).alias("value")))])
    own = actions.select("target_type", "target_id", "action_type").distinct()
    own = own.withColumn("effect", effect[F.concat_ws(":", "target_type", "action_type")]).where("effect IS NOT NULL")
    own = own.select(F.col("target_type").alias("table"), F.col("target_id").alias("id"), "effect.column", "effect.value")
    shown = F.explode(F.filter(F.array(*[F.struct(F.lit(kind).alias("table"), F.col(f"{kind}_id").alias("shown")) for kind in ("post", "comment")]), lambda x: x["shown"].isNotNull()))
    shows = activities.select(F.col("id").alias("activity"), shown.alias("x")).select("activity", "x.table", F.col("x.shown").alias("id"))
    hidden = own.where(F.col("column").isin("feed_policy", "is_hidden")).join(shows, ["table", "id"])
    hidden = hidden.select(F.lit("activity").alias("table"), F.col("activity").alias("id"), F.lit("feed_policy").alias("column"), F.lit("hidden").alias("value"))
    return own.unionByName(hidden).groupBy("table", "id", "column").agg(F.max("value").alias("value")).select(*CHANGE)


def applied(rows: DataFrame, table: str, change_set: DataFrame) -> DataFrame:
    """A table (id, ...) with its changes: one join. Columns that the table lacks and the changes set are flags, else false."""
    columns = sorted({column for (kind, _), (column, _) in EFFECTS.items() if kind == table})
    mine = change_set.where(F.col("table") == table).groupBy("id").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"new {c}") for c in columns])
    out = rows.join(mine, "id", "left")
    for c in columns:
        new = F.col(f"new {c}")
        flag = c != "feed_policy"
        out = out.withColumn(c, F.coalesce(new.cast("boolean") if flag else new, F.col(c) if c in rows.columns else F.lit(False if flag else "normal")))
    return out.select(*rows.columns, *[c for c in columns if c not in rows.columns])


def moderate(actions: DataFrame, posts: DataFrame, comments: DataFrame, activities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The change set and the action rows of actions (target_type post or comment, target_id, action_type hide or lock,
    moderator_id, reason): those on a target that is there, each with its author as target_user_id."""
    authors = reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("target_type"), F.col("id").alias("target_id"), F.col("author_id").alias("target_user_id")) for kind, rows in (("post", posts), ("comment", comments))])
    done = actions.where(F.col("action_type").isin("hide", "lock")).join(authors, ["target_type", "target_id"])
    return changes(done, activities), action_rows(done)


def action_rows(actions: DataFrame) -> DataFrame:
    """(report_id, moderator_id, target_user_id, action_type, reason) and a `<kind>_id` for each kind of target."""
    there = lambda c, kind: F.col(c) if c in actions.columns else F.lit(None).cast(kind).alias(c)
    ids = [F.when(F.col("target_type") == kind, F.col("target_id")).alias(f"{kind}_id") for kind in TARGETS]
    return actions.select(there("report_id", "long"), "moderator_id", there("target_user_id", "long"), "action_type", F.coalesce(there("reason", "string"), F.lit("")).alias("reason"), *ids)


def apply_moderation(rows: dict[str, DataFrame], actions: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables post, comment and activity after actions, and the action rows."""
    change_set, done = moderate(actions, rows["post"], rows["comment"], rows["activity"])
    return {name: applied(table, name, change_set) for name, table in rows.items()}, done


def resolved(reports: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending reports take their resolution (id, status, action_type, moderator_id); returns reports and action rows.

    Rejected ones carry no action, nor do resolved ones without a type; reports that aren't pending don't change. Of
    several resolutions of a report one counts: a resolved one before a rejected one, then the moderator with the smallest
    id. The action row names the report's target, of whatever kind, and the reported user."""
    first = F.struct(F.col("status") != "resolved", F.col("moderator_id"), F.coalesce("action_type", F.lit("")))
    reason = F.col("reason") if "reason" in resolutions.columns else F.lit("")
    r = resolutions.groupBy("id").agg(F.min_by(F.struct(F.col("status").alias("new_status"), "action_type", "moderator_id", reason.alias("reason")), first).alias("r"))
    joined = reports.join(r, "id", "left")
    applies = (F.col("status") == "pending") & F.col("r.new_status").isNotNull()
    status = F.when(applies, F.col("r.new_status")).otherwise(F.col("status"))
    out = joined.select(*[status.alias(c) if c == "status" else F.col(c) for c in reports.columns], F.when(applies, F.col("r.moderator_id")).alias("resolved_by"))
    acted = targets(joined.where(applies & (F.col("r.new_status") == "resolved") & F.col("r.action_type").isNotNull()), TARGETS)
    user = F.col("reported_user_id") if "reported_user_id" in reports.columns else F.lit(None).cast("long")
    return out, action_rows(acted.select(F.col("id").alias("report_id"), "target_type", "target_id", user.alias("target_user_id"), "r.moderator_id", "r.action_type", "r.reason"))


def apply_reports(rows: dict[str, DataFrame], reports: DataFrame, resolutions: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The tables post, comment and activity after reports are resolved, the reports, and the action rows."""
    out, actions = resolved(reports, resolutions)
    change_set = changes(targets(actions, TARGETS), rows["activity"])
    return {name: applied(table, name, change_set) for name, table in rows.items()}, out, actions
