"""From landed payloads to typed rows, relation changes, and the state of the sync jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import ordering, placed

from ..functions.text import cleaned, filled, stripped

#: Codes of the payloads.
EPISODE_TYPES = ["EP", "SP", "OP", "ED", "PV/CM", "MAD", "ETC"]
PERSON_TYPES = ["Individual", "Company", "Group"]
CHARACTER_TYPES = ["Character", "Mech", "Ship", "Organization"]
BLOOD_TYPES = ["A", "B", "AB", "O"]
IMAGE_SIZES = ["large", "common", "medium", "grid", "small"]
SHARD = 16_384


def is_type(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v) == kind, F.lit(False))


def string_of(v: Column) -> Column:
    return F.when(is_type(v, "STRING"), F.try_variant_get(v, "$", "string"))


def int_of(v: Column) -> Column:
    return F.when(is_type(v, "BIGINT"), F.try_variant_get(v, "$", "bigint"))


def flag_of(v: Column) -> Column:
    return F.coalesce(F.when(is_type(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean")), F.lit(False))


def date_of(v: Column) -> Column:
    """ISO dates, also without hyphens; anything else is null."""
    s = string_of(v)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd")).when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd"))


def clean_of(v: Column, longest: int | None = None) -> Column:
    return cleaned(string_of(v), longest)


def elements(v: Column) -> Column:
    """The elements of a JSON list; empty for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def strings_of(v: Column) -> Column:
    """The non-blank strings of a JSON list, stripped."""
    return F.filter(F.transform(elements(v), lambda x: clean_of(x)), lambda s: s != "")


def code(v: Column, names: list[str], first: int) -> Column:
    n = int_of(v)
    return F.coalesce(F.when((n >= first) & (n < first + len(names)), F.get(F.array(*map(F.lit, names)), (n - first).cast("int"))), F.lit(""))


def image(v: Column, size: str) -> Column:
    return clean_of(F.try_variant_get(v, f"$.{size}", "variant"), 1024)


def infobox(v: Column) -> Column:
    """{key, value[]} items: a string value is one entry, a list gives the strings of its `v`; items with neither key nor
    value are dropped."""
    field = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    value = lambda x: F.when(is_type(field(x, "value"), "STRING"), F.filter(F.array(clean_of(field(x, "value"))), lambda s: s != "")).otherwise(F.filter(F.transform(elements(field(x, "value")), lambda e: clean_of(field(e, "v"))), lambda s: s != ""))
    items = F.filter(elements(v), lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    pairs = F.transform(items, lambda x: F.struct(clean_of(field(x, "key")).alias("key"), value(x).alias("value")))
    return F.filter(pairs, lambda p: (p["key"] != "") | (F.size(p["value"]) > 0))


def classified(kind: Column, platform: Column, tags: Column) -> Column:
    book = F.when(F.contains(platform, F.lit("小说")), "novel").when(F.contains(platform, F.lit("漫画")), "manga").otherwise("book")
    game = F.when(F.exists(tags, lambda t: F.lower(t) == "galgame"), "galgame").otherwise("game")
    return F.when(kind == 1, book).when(kind == 2, "anime").when(kind == 3, "music").when(kind == 4, game).otherwise("other")


def subject_tags(p: str = "p") -> Column:
    """meta_tags, or metatag where the first is absent or a JSON null; repeats stay. Names as the provider gives them."""
    tags = F.col(f"{p}.meta_tags")
    return strings_of(F.when(tags.isNull() | F.is_variant_null(tags), F.col(f"{p}.metatag")).otherwise(tags))


def normalized_lists(rows: DataFrame, column: str, key: str, mapping: DataFrame) -> DataFrame:
    """A list of names by their mapping, in order; names that come out empty are dropped. Rows are told apart by `key`."""
    names = normalize_names(rows.select(key, F.posexplode(column).alias("at", "name")), "name", mapping).where("name <> ''")
    lists = names.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("normal"))
    return rows.join(lists, key, "left").withColumn(column, F.coalesce("normal", F.array().cast("array<string>"))).drop("normal")


def map_subjects(rows: DataFrame) -> DataFrame:
    """Parsed subject payloads (column p) as subject rows."""
    p = lambda c: F.col(f"p.{c}")
    tags = subject_tags()
    return rows.where("p IS NOT NULL").select(
        *[c for c in rows.columns if c != "p"],
        classified(int_of(p("type")), clean_of(p("platform"), 256), tags).alias("subject_type"), clean_of(p("name"), 256).alias("title"), clean_of(p("name_cn"), 256).alias("title_cn"), date_of(p("date")).alias("date"),
        image(p("images"), "large").alias("image_original"), image(p("images"), "medium").alias("image_thumbnail"), clean_of(p("platform"), 256).alias("platform"), clean_of(p("summary")).alias("description"),
        flag_of(p("nsfw")).alias("nsfw"), flag_of(p("series")).alias("series"), int_of(p("volumes")).alias("volumes"), int_of(p("eps")).alias("eps"), int_of(p("total_episodes")).alias("total_episodes"), infobox(p("infobox")).alias("infobox"), tags.alias("tags"),
    )


def map_episodes(rows: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"p.{c}")
    seconds = int_of(p("duration_seconds"))
    return rows.where("p IS NOT NULL").select(
        *[c for c in rows.columns if c != "p"],
        clean_of(p("name"), 256).alias("title"), code(p("type"), EPISODE_TYPES, 0).alias("type"), int_of(p("ep")).alias("ep_num"), int_of(p("sort")).alias("sort"),
        F.when(seconds > 0, seconds).alias("duration"), date_of(p("airdate")).alias("date"), clean_of(p("desc")).alias("description"),
    )


def birth() -> Column:
    year, month, day = (int_of(F.col(f"p.birth_{c}")) for c in ("year", "month", "day"))
    return F.when(year.isNotNull() | month.isNotNull() | day.isNotNull(), F.struct(year.alias("year"), month.alias("month"), day.alias("day")))


def map_people(rows: DataFrame, kind: str = "staff") -> DataFrame:
    """Parsed person payloads (kind staff) or character payloads as rows."""
    p = lambda c: F.col(f"p.{c}")
    own = [code(p("type"), PERSON_TYPES, 1).alias("type"), strings_of(p("career")).alias("career")] if kind == "staff" else [code(p("type"), CHARACTER_TYPES, 1).alias("type"), code(p("blood_type"), BLOOD_TYPES, 1).alias("blood_type")]
    return rows.where("p IS NOT NULL").select(
        *[c for c in rows.columns if c != "p"], clean_of(p("name"), 256).alias("name"), clean_of(p("summary")).alias("description"), clean_of(p("gender"), 64).alias("gender"), birth().alias("birth"), *own,
        image(p("images"), "large").alias("image_original"), image(p("images"), "medium").alias("image_thumbnail"), infobox(p("infobox")).alias("infobox"),
    )


def flatten_relations(rows: DataFrame, parent: str, listed: str) -> DataFrame:
    """(parent, target_id, relation) from a payload list of {id, relation}; other items are dropped, each pair once."""
    item = F.explode(elements(F.col(listed))).alias("item")
    target = int_of(F.try_variant_get(F.col("item"), "$.id", "variant"))
    return rows.select(parent, item).select(parent, target.alias("target_id"), clean_of(F.try_variant_get(F.col("item"), "$.relation", "variant")).alias("relation")).where("target_id IS NOT NULL").distinct()


def flatten_actors(rows: DataFrame, parent: str, listed: str) -> DataFrame:
    """(parent, character_id, actor_id) from a payload list of characters with their actors."""
    field = lambda name: F.try_variant_get(F.col("item"), f"$.{name}", "variant")
    people = rows.select(parent, F.explode(elements(F.col(listed))).alias("item")).select(parent, int_of(field("id")).alias("character_id"), F.explode(elements(field("actors"))).alias("item"))
    return people.select(parent, "character_id", int_of(field("id")).alias("actor_id")).where("character_id IS NOT NULL AND actor_id IS NOT NULL").distinct()


def calendar_flatten(days: DataFrame) -> DataFrame:
    """(subject_id, weekday_en, doing) from weekday groups (pos, p: variant); the last weekday of a subject holds."""
    field = lambda x, path: F.try_variant_get(F.col(x), path, "variant")
    items = days.select("pos", clean_of(field("p", "$.weekday.en")).alias("weekday_en"), F.posexplode(elements(field("p", "$.items"))).alias("place", "item"))
    doing = F.greatest(F.lit(0), F.coalesce(int_of(field("item", "$.collection.doing")), F.lit(0)))
    rows = items.select("pos", "place", "weekday_en", int_of(field("item", "$.id")).alias("subject_id"), doing.alias("doing")).where("subject_id IS NOT NULL")
    return rows.groupBy("subject_id").agg(F.max_by(F.struct("weekday_en", "doing"), F.struct("pos", "place")).alias("x")).select("subject_id", "x.*")


def calendar_count(days: DataFrame) -> DataFrame:
    """(n): valid items of all weekday groups, repeats included."""
    items = days.select(F.explode(elements(F.try_variant_get(F.col("p"), "$.items", "variant"))).alias("item"))
    return items.select(int_of(F.try_variant_get(F.col("item"), "$.id", "variant")).alias("id")).where("id IS NOT NULL").agg(F.count("*").alias("n"))


#: Content types and endings of covers.
CONTENT_TYPES = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp"}
ENDINGS = {".jpg": ".jpg", ".jpeg": ".jpg", ".png": ".png", ".webp": ".webp"}


def cover_extension(url: Column, content_type: Column) -> Column:
    """The ending of a cover's file: by its content type, else by its URL's path, else .jpg."""
    named = lambda names, x: F.create_map(*[F.lit(p) for pair in names.items() for p in pair])[x]
    path = F.lower(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"[^/.][^/]*?(\.[^./]+)$", 1))
    return F.coalesce(named(CONTENT_TYPES, content_type), named(ENDINGS, path), F.lit(".jpg"))


def cover_pick(images: dict[str, Column], hosts: list[str]) -> Column:
    """The first non-empty image if its URL is http(s) on an allowed host or a subdomain of one; else null."""
    url = F.coalesce(*[filled(images[s]) for s in IMAGE_SIZES if s in images])
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    allowed = F.lit(False)
    for h in hosts:
        allowed = allowed | (host == h) | F.endswith(host, F.lit("." + h))
    return F.when(allowed & F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), url)


def normalize_names(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The stripped name's mapping, or itself; blank is empty."""
    name = F.coalesce(stripped(F.col(column)), F.lit(""))
    m = mapping.select(F.col("external_name").alias("mapped from"), "internal_name")
    out = rows.withColumn("mapped from", name).join(m, "mapped from", "left")
    return out.withColumn(column, F.coalesce("internal_name", "mapped from")).drop("mapped from", "internal_name")


def unmapped_names(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """(name, n) of names without a mapping, most frequent first."""
    counted = names.select(stripped(F.col("name")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))
    return counted.join(mapping.select(F.col("external_name").alias("name")), "name", "left_anti").orderBy(F.desc("n"), "name")


def relation_diff(old: DataFrame, new: DataFrame, refreshed: DataFrame, key: str) -> DataFrame:
    """Links to create and delete (`change`) for the refreshed parents; other parents' links are left alone."""
    mine = old.join(refreshed.select(key).distinct(), key, "left_semi").select(*old.columns)
    create = new.select(*old.columns).subtract(mine).withColumn("change", F.lit("create"))
    return create.unionByName(mine.subtract(new.select(*old.columns)).withColumn("change", F.lit("delete")))


def window_result(outcomes: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return outcomes.groupBy("task").agg(F.count("*").alias("processed"), n("synced"), n("skipped"), n("failed"))


def run_before(ranges: DataFrame, resets: str, inside: str) -> DataFrame:
    """What a run counts when a range (task, range) begins, from each range's number of resets and the length of the run it
    ends with: its last one after a reset, or all of it without."""
    order = Window.partitionBy("task").orderBy("range")
    so_far = F.sum(F.col(inside)).over(Window.partitionBy("task", f"{resets} so far").orderBy("range"))
    return ranges.withColumn(f"{resets} so far", F.count_if(F.col(resets) > 0).over(order)).withColumn("ends with", so_far).withColumn(f"{inside} before", F.coalesce(F.lag("ends with").over(order), F.lit(0))).drop("ends with", f"{resets} so far")


def sync_frontier(outcomes: DataFrame, end: DataFrame, skips: int = 50, errors: int = 20, size: int = SHARD) -> DataFrame:
    """(task, cursor, stopped): where a scan over (task, entity, outcome) stops.

    `skips` entities skipped since the last synced one (failures neither count nor break the run) or `errors` failures
    running stop it; the cursor is then the last synced entity before the stop, or the one before the first if there is
    none; a scan that runs through ends at the window's end (task, end_id).

    Entities are taken in ranges of `size` ids. A range tells with which run it ends; laid after each other, a row a range,
    these tell with which run a range begins, and its own rows do the rest. No task holds more than a range of rows, or a
    row for each range of a scan.
    """
    rows = outcomes.select("task", "entity", "outcome", F.floor(F.col("entity") / size).alias("range"))
    own = Window.partitionBy("task", "range").orderBy("entity")
    synced, failed = F.col("outcome") == "synced", F.col("outcome") == "failed"
    last = {"synced": F.max(F.when(synced, F.col("entity"))), "worked": F.max(F.when(~failed, F.col("entity")))}
    ends = rows.groupBy("task", "range").agg(*[c.alias(f"last {name}") for name, c in last.items()])
    after = lambda name, kind: F.count_if((F.col("outcome") == kind) & (F.coalesce(F.col("entity") > F.col(f"last {name}"), F.lit(True))))
    tails = rows.join(ends, ["task", "range"]).groupBy("task", "range").agg(F.count("last synced").alias("synced"), F.count("last worked").alias("worked"), after("synced", "skipped").alias("skips"), after("worked", "failed").alias("fails"))
    starts = run_before(run_before(tails, "synced", "skips"), "worked", "fails").select("task", "range", "skips before", "fails before")
    runs = rows.withColumn("s", F.count_if(synced).over(own)).withColumn("e", F.count_if(~failed).over(own)).join(starts, ["task", "range"])
    inside = lambda run, kind, before: F.count_if(F.col("outcome") == kind).over(Window.partitionBy("task", "range", run).orderBy("entity")) + F.when(F.col(run) == 0, F.col(before)).otherwise(0)
    runs = runs.withColumn("skipping", inside("s", "skipped", "skips before")).withColumn("failing", inside("e", "failed", "fails before"))
    hit = F.when((F.col("skipping") >= skips) & (F.col("outcome") == "skipped"), F.struct("entity", F.lit("skips").alias("why"))).when((F.col("failing") >= errors) & failed, F.struct("entity", F.lit("errors").alias("why")))
    stops = runs.groupBy("task").agg(F.min(hit).alias("stop"), F.min("entity").alias("start"))
    done = outcomes.where("outcome = 'synced'").join(stops, "task").where("stop IS NULL OR entity < stop.entity").groupBy("task").agg(F.max("entity").alias("last"))
    out = stops.join(done, "task", "left").join(end, "task", "left")
    cursor = F.when(F.col("stop").isNull(), F.col("end_id")).otherwise(F.coalesce("last", F.col("start") - 1))
    return out.select("task", cursor.alias("cursor"), F.coalesce("stop.why", F.lit("end")).alias("stopped"))


def shard_plan(ranges: DataFrame, done: DataFrame, size: int = SHARD) -> DataFrame:
    """(task, first, last, resume): a range of ids in shards, each with the id to go on from."""
    shards = ranges.select("task", "end_id", F.explode(F.sequence("start_id", "end_id", F.lit(size))).alias("first"))
    shards = shards.select("task", "first", F.least(F.col("first") + size - 1, "end_id").alias("last"))
    out = shards.join(done.select("task", "first", "current_id"), ["task", "first"], "left")
    return out.select("task", "first", "last", F.greatest("first", F.coalesce(F.col("current_id") + 1, "first")).alias("resume"))


def next_windows(states: DataFrame, batch: int) -> DataFrame:
    """(task, first, last): the next `batch` ids of each scan (task, current_id, status) that isn't running."""
    return states.where("coalesce(status, 'idle') <> 'running'").select("task", (F.col("current_id") + 1).alias("first"), (F.col("current_id") + batch).alias("last"))


def shard_progress(states: DataFrame) -> DataFrame:
    """(task, share) of (task, shard 'a-b', current_id): ids done over all ids."""
    a, b = (F.element_at(F.split("shard", "-"), k).cast("long") for k in (1, 2))
    size = b - a + 1
    done = F.least(size, F.greatest(F.lit(0), F.coalesce(F.col("current_id"), a - 1) - a + 1))
    return states.groupBy("task").agg((F.sum(done) / F.sum(size)).alias("share"))


def sync_errors(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'failed'").groupBy("task", "entity").agg(F.count("*").alias("retry_count"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


#: Counters of a job, one for each step that is reported.
COUNTERS = ("processed", "synced", "skipped", "failed")


def job_rollup(progress: DataFrame) -> DataFrame:
    """(job, processed, synced, skipped, failed, last_label, started_at) of (job, the four steps, label, ts): no step counts
    below zero, a null step not at all; the label is the last one that isn't empty."""
    sums = [F.coalesce(F.sum(F.greatest(F.lit(0), F.col(c))), F.lit(0)).alias(c) for c in COUNTERS]
    label = F.max_by(filled(F.col("label").cast("string")), F.when(filled(F.col("label").cast("string")).isNotNull(), F.struct("ts", F.col("label").cast("string"))))
    return progress.groupBy("job").agg(*sums, F.coalesce(label, F.lit("")).alias("last_label"), F.min("ts").alias("started_at"))


def initial_cursor(rows: DataFrame, states: DataFrame) -> DataFrame:
    """(info_source, cursor): the highest all-digit id of filled rows, else the highest finished end_id, else 0."""
    number = F.when(F.col("id_source").rlike("^[0-9]+$"), F.col("id_source").try_cast("bigint"))
    a = rows.where("title <> ''").groupBy("info_source").agg(F.max(number).alias("a"))
    b = states.where("status = 'done'").groupBy("info_source").agg(F.max("end_id").alias("b"))
    return a.join(b, "info_source", "full").select("info_source", F.coalesce("a", "b", F.lit(0)).alias("cursor"))


def sync_status(tasks: DataFrame, states: DataFrame, cursors: DataFrame) -> DataFrame:
    """All tasks with their state; one without a row is idle at its initial cursor."""
    out = tasks.join(states.select("task", "status", "current_id"), "task", "left").join(cursors.select("task", "cursor"), "task", "left")
    return out.select("task", F.coalesce("status", F.lit("idle")).alias("status"), F.coalesce("current_id", "cursor", F.lit(0)).alias("current_id"))


def subject_gate(ids: DataFrame, subjects: DataFrame, source: str) -> DataFrame:
    """Ids whose subject exists under the source."""
    known = subjects.where(F.col("info_source") == source).select("id_source")
    return ids.join(known, "id_source", "left_semi")


def subject_dependents(links: dict[str, DataFrame]) -> DataFrame:
    """(subject_id, kind, n): distinct things to refresh with a subject; links: kind to (subject_id, other)."""
    out = None
    for kind, rows in links.items():
        some = rows.select("subject_id", F.lit(kind).alias("kind"), F.col("other"))
        out = some if out is None else out.unionByName(some)
    return out.distinct().groupBy("subject_id", "kind").agg(F.count("*").alias("n"))


def sync_jobs_list(jobs: DataFrame, status: str | None = None, job_type: str | None = None) -> DataFrame:
    """Jobs, newest first, with their `place` among those of the same status."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    rows = rows if job_type is None else rows.where(F.col("job_type") == job_type)
    return placed(rows, "status", ordering("-created_at"))
