"""Queries of the ingest, its jobs' state, the audits and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import cleaned
from ..operators import audit as a
from ..operators import ingest as g
from ..sources import tables as t
from ..sources.shared import shared_path, spread
from ..sources.versions import VersionedTable
from ..streaming import jobs
from .registry import query


def text(*columns):
    return [F.col(x).cast("string").alias(x) for x in columns]


def subject_payloads(v):
    """JSON texts of subjects as a provider lands them, some malformed, built from the part table."""
    n = F.col("p_partkey")
    name = F.when(n % 17 == 0, F.lit("5")).otherwise(F.concat(F.lit('"  '), F.col("p_name"), F.lit(' "')))
    date = F.when(n % 13 == 0, F.lit('"1999-99-01"')).when(n % 13 == 1, F.lit("19990101")).when(n % 13 == 2, F.lit('"19990102"')).otherwise(F.concat(F.lit('"'), F.date_add(F.lit("1999-01-01").cast("date"), (n % 300).cast("int")).cast("string"), F.lit('"')))
    platform = F.when(n % 5 == 0, F.lit("小说 A")).when(n % 5 == 1, F.lit("漫画 B")).otherwise(F.col("p_type"))
    tags = F.when(n % 7 == 0, F.lit('["GalGame", " ", 3]')).when(n % 7 == 1, F.lit("null")).when(n % 7 == 2, F.lit('"Brand#1"')).when(n % 7 == 3, F.concat(F.lit('["x", "'), F.col("p_brand"), F.lit('", "x"]'))).otherwise(F.concat(F.lit('[" '), F.col("p_brand"), F.lit('"]')))
    box = F.concat(F.lit('[{"key": "a", "value": " '), F.col("p_brand"), F.lit('"}, {"key": "", "value": ""}, 7, {"key": "b", "value": [{"v": "x"}, {"v": 1}, {"v": "y"}]}]'))
    body = F.concat(F.lit('{"id": '), (n + 1).cast("string"), F.lit(', "type": '), (n % 7).cast("string"), F.lit(', "name": '), name, F.lit(', "date": '), date, F.lit(', "platform": "'), platform, F.lit('", "nsfw": '), F.when(n % 3 == 0, F.lit("true")).otherwise(F.lit("1")),
        F.lit(', "eps": '), F.when(n % 4 == 0, F.lit('"12"')).otherwise(F.col("p_size").cast("string")), F.lit(', "images": {"large": "https://img.example.org/'), n.cast("string"), F.lit('.jpg"}, "meta_tags": '), tags, F.lit(', "metatag": ["other"], "infobox": '), box, F.lit("}"))
    value = F.when(n % 29 == 0, F.lit("[1, 2]")).when(n % 29 == 1, F.lit("{broken")).otherwise(body)
    return spread(v.part, "p_partkey").select(n.alias("id_source"), value.alias("value"))


def subject_rows(v):
    return t.quarantined(t.parsed(subject_payloads(v), "subject"))[0]


GOOD = "FROM {part} WHERE p_partkey % 29 > 1"
PLATFORM = "CASE p_partkey % 5 WHEN 0 THEN '小说 A' WHEN 1 THEN '漫画 B' ELSE p_type END"
CLASS = f"CASE p_partkey % 7 WHEN 1 THEN CASE p_partkey % 5 WHEN 0 THEN 'novel' WHEN 1 THEN 'manga' ELSE 'book' END WHEN 2 THEN 'anime' WHEN 3 THEN 'music' WHEN 4 THEN 'game' ELSE 'other' END"


@query("SELECT CASE p_partkey % 29 WHEN 0 THEN 'not an object' WHEN 1 THEN 'not JSON' ELSE CASE WHEN p_partkey % 31 = 5 THEN 'empty' WHEN p_partkey % 31 = 6 THEN 'no id' ELSE 'read' END END AS outcome, count(*) AS n FROM {part} GROUP BY 1")
def read_payloads(v):
    """Payloads are landed as files and read from there; what can't be used is read from the table of rejects."""
    landed, rejects = shared_path(v.spark, "landed"), shared_path(v.spark, "rejects")
    n = F.col("id_source")
    odd = F.when((n % 31 == 5) & (n % 29 > 1), F.lit("  ")).when((n % 31 == 6) & (n % 29 > 1), F.lit('{"id": "x"}')).otherwise(F.col("value"))
    subject_payloads(v).select(odd.alias("value")).write.text(landed)
    good = t.read_payloads(v.spark, landed, "subject", rejects)
    rows = good.select(F.lit("read").alias("outcome")).unionByName(v.spark.read.parquet(rejects).select(F.col("reason").alias("outcome")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""SELECT p_partkey AS id_source, {CLASS} AS subject_type, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS title, CAST(CASE WHEN p_partkey % 13 IN (0, 1) THEN NULL WHEN p_partkey % 13 = 2 THEN DATE '1999-01-02' ELSE DATE '1999-01-01' + CAST(p_partkey % 300 AS INT) END AS STRING) AS date,
    {PLATFORM} AS platform, p_partkey % 3 = 0 AS nsfw, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE CAST(p_size AS BIGINT) END AS eps, concat('https://img.example.org/', CAST(p_partkey AS STRING), '.jpg') AS image_original {GOOD}""")
def map_subjects(v):
    return g.map_subjects(subject_rows(v)).fillna(-1, ["eps"]).select("id_source", "subject_type", "title", F.col("date").cast("string").alias("date"), "platform", "nsfw", "eps", "image_original")


@query(f"SELECT {CLASS} AS subject_type, count(*) AS n {GOOD} GROUP BY 1")
def classify_subject(v):
    return g.map_subjects(subject_rows(v)).groupBy("subject_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id_source, CASE p_partkey % 7 WHEN 0 THEN 'GalGame' WHEN 1 THEN 'other' WHEN 2 THEN '' WHEN 3 THEN concat('x,', coalesce(internal_name, p_brand), ',x') ELSE coalesce(internal_name, p_brand) END AS tags FROM {part} LEFT JOIN {name_mapping} ON external_name = p_brand WHERE p_partkey % 29 > 1")
def subject_tags(v):
    rows = subject_rows(v).select("id_source", g.subject_tags().alias("tags"))
    return g.normalized_lists(rows, "tags", "id_source", v.name_mapping).select("id_source", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT p_partkey AS id_source, concat('a=', p_brand, ';b=x,y') AS infobox {GOOD}")
def map_infobox(v):
    box = F.transform(g.infobox(F.col("p.infobox")), lambda i: F.concat(i["key"], F.lit("="), F.array_join(i["value"], ",")))
    return subject_rows(v).select("id_source", F.array_join(box, ";").alias("infobox"))


def episode_payloads(v):
    n = F.col("id")
    body = F.to_json(F.struct((n + 1).alias("id"), F.concat(F.lit(" ep "), F.col("sort").cast("string")).alias("name"), (n % 8).alias("type"), F.col("ep_num").alias("ep"), F.col("sort"), (n % 3 * 60 - 60).alias("duration_seconds"), F.when(n % 4 == 0, "2001-02-30").otherwise("2001-02-03").alias("airdate")))
    return t.quarantined(t.parsed(spread(v.episode, "id").select(n.alias("id_source"), "subject_id", body.alias("value")), "episode"))[0]


EPISODES = "SELECT id AS id_source, concat('ep ', CAST(sort AS STRING)) AS title, CASE id % 8 WHEN 0 THEN 'EP' WHEN 1 THEN 'SP' WHEN 2 THEN 'OP' WHEN 3 THEN 'ED' WHEN 4 THEN 'PV/CM' WHEN 5 THEN 'MAD' WHEN 6 THEN 'ETC' ELSE '' END AS type, CAST(coalesce(ep_num, -1) AS BIGINT) AS ep_num, CAST(CASE WHEN id % 3 = 2 THEN 60 ELSE -1 END AS BIGINT) AS duration, CASE WHEN id % 4 = 0 THEN NULL ELSE '2001-02-03' END AS date FROM {episode}"


@query(EPISODES)
def map_episodes(v):
    return g.map_episodes(episode_payloads(v)).fillna(-1, ["ep_num", "duration"]).select("id_source", "title", "type", "ep_num", "duration", F.col("date").cast("string").alias("date"))


def person_payloads(v, kind):
    n = F.col("s_suppkey")
    body = F.to_json(F.struct((n + 1).alias("id"), F.col("s_name").alias("name"), (n % 6).alias("type"), (n % 5).alias("blood_type"), F.when(n % 2 == 0, n % 100 + 1900).alias("birth_year"), F.when(n % 3 == 0, F.array(F.lit(" actor "), F.lit(""), F.lit("SMALL"))).alias("career")))
    return t.quarantined(t.parsed(spread(v.supplier, "s_suppkey").select(F.col("s_suppkey").alias("id_source"), body.alias("value")), kind))[0]


@query("SELECT s_suppkey AS id_source, s_name AS name, CASE s_suppkey % 6 WHEN 1 THEN 'Individual' WHEN 2 THEN 'Company' WHEN 3 THEN 'Group' ELSE '' END AS type, CASE WHEN s_suppkey % 3 = 0 THEN 'actor,Novel' ELSE '' END AS career, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 100 + 1900 ELSE -1 END AS birth_year FROM {supplier}")
def map_staff(v):
    people = g.normalized_lists(g.map_people(person_payloads(v, "person")), "career", "id_source", v.name_mapping)
    return people.select("id_source", "name", "type", F.array_join("career", ",").alias("career"), F.coalesce("birth.year", F.lit(-1).cast("long")).alias("birth_year"))


@query("SELECT s_suppkey AS id_source, s_name AS name, CASE s_suppkey % 6 WHEN 1 THEN 'Character' WHEN 2 THEN 'Mech' WHEN 3 THEN 'Ship' WHEN 4 THEN 'Organization' ELSE '' END AS type, CASE s_suppkey % 5 WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'AB' WHEN 4 THEN 'O' ELSE '' END AS blood_type FROM {supplier}")
def map_characters(v):
    return g.map_people(person_payloads(v, "character"), "character").select("id_source", "name", "type", "blood_type")


def listed(v):
    """One JSON list per subject of its staff links, with items that aren't objects or have no number."""
    item = F.concat(F.lit('{"id": '), F.when(F.col("staff_id") % 11 == 0, F.lit('"x"')).otherwise(F.col("staff_id").cast("string")), F.lit(', "relation": " '), F.col("role"), F.lit('", "actors": [{"id": '), (F.col("staff_id") % 7).cast("string"), F.lit('}, 3, {"id": null}]}'))
    rows = v.subject_staff.groupBy("subject_id").agg(F.concat(F.lit("[4, "), F.array_join(F.collect_list(item), ", "), F.lit("]")).alias("value"))
    return rows.select("subject_id", F.try_parse_json("value").alias("list"))


@query("SELECT DISTINCT subject_id, staff_id AS target_id, role AS relation FROM {subject_staff} WHERE staff_id % 11 <> 0")
def flatten_relations(v):
    return g.flatten_relations(listed(v), "subject_id", "list")


@query("SELECT DISTINCT subject_id, staff_id AS character_id, staff_id % 7 AS actor_id FROM {subject_staff} WHERE staff_id % 11 <> 0")
def flatten_actors(v):
    return g.flatten_actors(listed(v), "subject_id", "list")


def calendar_days(v):
    """Weekday groups as landed, with items that aren't objects; the first one repeats all subjects of the others."""
    day = F.array_position(F.array(*[F.lit(d) for d in ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]]), F.col("weekday_en"))
    rows = v.calendar_subject.withColumn("pos", F.when(day == 0, 7).otherwise(day)).withColumn("en", F.when(day == 0, "Sunday").otherwise(F.col("weekday_en")))
    item = F.concat(F.lit('{"id": '), F.col("subject_id").cast("string"), F.lit(', "collection": {"doing": '), F.when(F.col("collection_doing") % 4 == 0, F.lit("-3")).otherwise(F.col("collection_doing").cast("string")), F.lit("}}"))
    twice = rows.unionByName(rows.where("pos < 7").withColumn("pos", F.lit(0)).withColumn("en", F.lit("Early")))
    days = twice.groupBy("pos", "en").agg(F.concat(F.lit('{"weekday": {"en": "'), F.first("en"), F.lit('"}, "items": ["bad", '), F.array_join(F.collect_list(item), ", "), F.lit("]}")).alias("value"))
    return days.select("pos", F.try_parse_json("value").alias("p"))


@query("SELECT subject_id, CASE WHEN weekday_en = '' THEN 'Sunday' ELSE weekday_en END AS weekday_en, CAST(CASE WHEN collection_doing % 4 = 0 THEN 0 ELSE collection_doing END AS BIGINT) AS doing FROM {calendar_subject}")
def calendar_flatten(v):
    return g.calendar_flatten(calendar_days(v)).select("subject_id", "weekday_en", "doing")


@query("SELECT count(*) + count(*) FILTER (WHERE weekday_en NOT IN ('', 'Sunday')) AS n FROM {calendar_subject}")
def calendar_count(v):
    return g.calendar_count(calendar_days(v))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.webp' WHEN 2 THEN '.png' WHEN 3 THEN '.jpg' ELSE '.jpg' END AS ending FROM pages")
def cover_extension(v):
    n = F.col("page_id")
    url = F.concat(F.lit("https://img.example.org/a.b/"), n.cast("string"), F.when(n % 5 == 2, ".PNG?x=.webp").when(n % 5 == 3, ".jpeg").when(n % 5 == 4, "").otherwise(".gif"))
    return v.pages.select("page_id", g.cover_extension(url, F.when(n % 5 == 0, "image/png").when(n % 5 == 1, "image/webp").otherwise("text/html")).alias("ending"))


@query("SELECT event_type AS task, max(event_id) + 1 AS first, max(event_id) + 1000 AS last FROM events WHERE event_type <> 'view' GROUP BY 1")
def next_windows(v):
    states = v.events.groupBy(F.col("event_type").alias("task")).agg(F.max("event_id").alias("current_id"))
    return g.next_windows(states.withColumn("status", F.when(F.col("task") == "view", "running").when(F.col("task") == "click", "done")), 1000)


@query("SELECT page_id, CASE WHEN url LIKE '%://tionsh.example.net/%' OR url LIKE '%.tionsh.example.net/%' OR url LIKE '%.example.org/%' THEN url END AS cover FROM pages")
def cover_pick(v):
    return v.pages.select("page_id", g.cover_pick({"large": F.lit(""), "common": F.col("url")}, ["tionsh.example.net", "example.org"]).alias("cover"))


@query("SELECT p_partkey, trim(p_name) AS clean, substr(trim(p_name), 1, 4) AS short FROM part")
def clean_string(v):


    padded = F.concat(F.lit("  \t\n"), F.col("p_name"), F.lit("　 "))
    return v.part.select("p_partkey", cleaned(padded).alias("clean"), cleaned(padded, 4).alias("short"))


@query("SELECT c_custkey, lower(concat('Person', CAST(c_custkey AS STRING), '@EXAMPLE.com')) AS email FROM customer")
def normalize_email(v):
    return v.customer.select("c_custkey", F.lower(F.concat(F.lit("Person"), F.col("c_custkey").cast("string"), F.lit("@EXAMPLE.com"))).alias("email"))


@query("SELECT p_partkey, coalesce(internal_name, p_type) AS name FROM part LEFT JOIN {name_mapping} ON external_name = p_type")
def normalize_names(v):
    return g.normalize_names(v.part.select("p_partkey", F.concat(F.lit(" "), F.col("p_type"), F.lit("\t")).alias("name")), "name", v.name_mapping)


@query("SELECT p_brand AS name, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT external_name FROM {name_mapping}) GROUP BY 1")
def unmapped_names(v):
    return g.unmapped_names(v.part.select(F.col("p_brand").alias("name")), v.name_mapping)


@query("SELECT l_orderkey AS subject_id, page, pos, element FROM (SELECT l_orderkey, l_linenumber AS page, CAST(n AS INT) AS pos, l_partkey * 10 + n AS element FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) x JOIN {numbers} ON n < 3) y")
def merge_pages(v):
    pages = v.lineitem.groupBy(F.col("l_orderkey").alias("subject_id"), F.col("l_linenumber").alias("page")).agg(F.min("l_partkey").alias("k"))
    return t.merge_pages(pages.withColumn("data", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("k") * 10 + i)))


def old_subjects(v):
    return v.subject.where("id % 3 <> 0").select("id", "info_source", "id_source", "title", F.col("platform"), F.lit("kept").alias("note"))


@query("SELECT id, id_source, CASE WHEN id % 2 = 0 THEN concat('new ', title) ELSE title END AS title, CASE WHEN id % 3 <> 0 THEN 'kept' END AS note FROM {subject} WHERE id % 3 <> 0 OR id % 2 = 0")
def upsert_entities(v):
    new = v.subject.where("id % 2 = 0").select("id", "info_source", "id_source", F.concat(F.lit("new "), F.col("title")).alias("title"), "platform")
    return t.upsert(old_subjects(v), new).select("id", "id_source", "title", "note")


@query("SELECT id_source, max(place) AS place FROM (SELECT l_partkey AS id_source, l_orderkey * 10 + l_linenumber AS place FROM lineitem UNION ALL SELECT p_partkey, -1 FROM part) x GROUP BY 1")
def upsert_episodes(v):
    landed = v.lineitem.select(F.lit("s").alias("info_source"), F.col("l_partkey").alias("id_source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    new = t.last_by_place(landed.withColumn("p", F.col("place")), t.IDENTITY, ["p"]).drop("p")
    old = v.part.select(F.lit("s").alias("info_source"), F.col("p_partkey").alias("id_source"), F.lit(-1).cast("long").alias("place"))
    return t.upsert(old, new).select("id_source", "place")


@query("SELECT DISTINCT subject_id AS id_source FROM {subject_staff} WHERE subject_id NOT IN (SELECT id FROM {subject} WHERE id % 2 = 0)")
def insert_missing_stubs(v):
    return t.missing_stubs(v.subject_staff.select(F.col("subject_id").alias("id_source")), v.subject.where("id % 2 = 0").select(F.col("id").alias("id_source")))


@query("SELECT info_source, id FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS info_source, p_partkey AS id FROM part) x WHERE info_source = 'b' UNION ALL SELECT 'a', p_partkey + 5 FROM part WHERE p_partkey % 9 = 0")
def replace_snapshot(v):
    old = v.part.select(F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("info_source"), F.col("p_partkey").alias("id"))
    return t.replace_snapshot(old, v.part.where("p_partkey % 9 = 0").select(F.lit("a").alias("info_source"), (F.col("p_partkey") + 5).alias("id")))


@query("""SELECT collection_id, mark_id, CAST(place AS BIGINT) AS place FROM {item} WHERE collection_id % 2 = 1 UNION ALL SELECT collection_id, mark_id, row_number() OVER (PARTITION BY collection_id ORDER BY first, mark_id) - 1 FROM (SELECT collection_id, mark_id, min(-place) AS first FROM {item} WHERE collection_id % 2 = 0 GROUP BY 1, 2) x""")
def replace_children(v):
    new = v.item.where("collection_id % 2 = 0").select("collection_id", "mark_id", (-F.col("place")).alias("place"))
    old = v.item.select("collection_id", "mark_id", F.col("place").cast("long").alias("place"))
    return t.replace_children(old, new.unionByName(new), v.collection.where("id % 2 = 0").select(F.col("id").alias("collection_id")), "collection_id", "mark_id")


@query("""SELECT source_id, target_id, relation, 'create' AS change FROM {subject_subject} WHERE source_id % 4 = 0 AND target_id % 3 = 0 AND target_id % 2 = 1 UNION ALL SELECT source_id, target_id, relation, 'delete' FROM {subject_subject} WHERE source_id % 4 = 0 AND target_id % 2 = 0 AND target_id % 3 <> 0""")
def relation_diff(v):
    old, new = v.subject_subject.where("target_id % 2 = 0"), v.subject_subject.where("target_id % 3 = 0 AND source_id % 4 = 0")
    return g.relation_diff(old, new, v.subject.where("id % 4 = 0").select(F.col("id").alias("source_id")), "source_id")


@query("SELECT task, count(*) AS processed, count(*) FILTER (WHERE outcome = 'synced') AS synced, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM {outcome} GROUP BY 1")
def window_result(v):
    return g.window_result(v.outcome)


@query("""SELECT task, CASE WHEN stop IS NULL THEN last_entity ELSE coalesce((SELECT max(entity) FROM {outcome} o WHERE o.task = y.task AND outcome = 'synced' AND entity < stop), start - 1) END AS cursor, CASE WHEN stop IS NULL THEN 'end' WHEN stop = skip_stop THEN 'skips' ELSE 'errors' END AS stopped FROM (
    SELECT task, min(entity) AS start, max(entity) AS last_entity, least(min(CASE WHEN skipping >= 4 AND outcome = 'skipped' THEN entity END), min(CASE WHEN failing >= 3 AND outcome = 'failed' THEN entity END)) AS stop, min(CASE WHEN skipping >= 4 AND outcome = 'skipped' THEN entity END) AS skip_stop FROM (
      SELECT *, count(*) FILTER (WHERE outcome = 'skipped') OVER (PARTITION BY task, s ORDER BY entity) AS skipping, count(*) FILTER (WHERE outcome = 'failed') OVER (PARTITION BY task, e ORDER BY entity) AS failing FROM (
        SELECT *, count(*) FILTER (WHERE outcome = 'synced') OVER (PARTITION BY task ORDER BY entity) AS s, count(*) FILTER (WHERE outcome <> 'failed') OVER (PARTITION BY task ORDER BY entity) AS e FROM {outcome}) a) b GROUP BY task) y""")
def sync_frontier(v):
    end = v.outcome.groupBy("task").agg(F.max("entity").cast("long").alias("end_id"))
    return g.sync_frontier(v.outcome.withColumn("entity", F.col("entity").cast("long")), end, 4, 3, 8)


@query("SELECT task, entity, 1 AS retry_count, CAST(ts AS STRING) AS first_at FROM {outcome} WHERE outcome = 'failed'")
def sync_errors(v):
    return g.sync_errors(v.outcome).select("task", F.col("entity").cast("long").alias("entity"), F.col("retry_count").cast("int").alias("retry_count"), *text("first_at"))


@query("SELECT event_type AS job, CAST(sum(greatest(0, step)) AS BIGINT) AS processed, CAST(sum(CASE WHEN event_id % 3 = 0 THEN greatest(0, step) ELSE 0 END) AS BIGINT) AS synced, CAST(sum(CASE WHEN event_id % 3 = 1 THEN greatest(0, step) ELSE 0 END) AS BIGINT) AS skipped, CAST(sum(CASE WHEN event_id % 3 = 2 THEN greatest(0, step) ELSE 0 END) AS BIGINT) AS failed, CAST(coalesce(arg_max(event_id, ts) FILTER (WHERE event_id % 2 = 0), 0) AS STRING) AS last_label, CAST(min(ts) AS STRING) AS started_at FROM (SELECT *, CAST(floor(value) AS BIGINT) - 20 AS step FROM events) x GROUP BY 1")
def job_rollup(v):
    step, n = F.floor("value") - 20, F.col("event_id")
    rows = v.events.select(F.col("event_type").alias("job"), step.alias("processed"), *[F.when(n % 3 == k, step).alias(name) for k, name in enumerate(g.COUNTERS[1:])], F.when(n % 2 == 0, n.cast("string")).otherwise("").alias("label"), "ts")
    return g.job_rollup(rows).select("job", *g.COUNTERS, "last_label", *text("started_at"))


SHARDS = "(SELECT o_orderpriority AS task, CAST(min(o_orderkey) AS BIGINT) AS start_id, CAST(min(o_orderkey) AS BIGINT) + count(*) * 10 AS end_id FROM orders GROUP BY 1)"


@query(f"SELECT task, start_id + n * 4096 AS first, least(start_id + n * 4096 + 4095, end_id) AS last, start_id + n * 4096 + CASE WHEN n = 0 THEN 101 ELSE 0 END AS resume FROM {SHARDS} x JOIN {{numbers}} ON start_id + n * 4096 <= end_id")
def shard_plan(v):
    ranges = v.orders.groupBy(F.col("o_orderpriority").alias("task")).agg(F.min("o_orderkey").alias("start_id"), F.count("*").alias("n")).select("task", "start_id", (F.col("start_id") + F.col("n") * 10).alias("end_id"))
    done = ranges.select("task", F.col("start_id").alias("first"), (F.col("start_id") + 100).alias("current_id"))
    return g.shard_plan(ranges, done, 4096)


@query("SELECT event_type AS task, round(CAST(sum(least(100, greatest(0, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 140 END))) AS DOUBLE) / sum(100), 9) AS share FROM events GROUP BY 1")
def shard_progress(v):
    start = F.col("event_id") * 100
    states = v.events.select(F.col("event_type").alias("task"), F.concat(start.cast("string"), F.lit("-"), (start + 99).cast("string")).alias("shard"), F.when(F.col("event_id") % 7 != 0, start + F.col("event_id") % 140 - 1).alias("current_id"))
    return g.shard_progress(states).select("task", F.round("share", 9).alias("share"))


@query("SELECT 'part' AS info_source, max(p_partkey) AS cursor FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'none', 77")
def initial_cursor(v):
    source = F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("x"), F.col("p_partkey").cast("string")))
    states = v.spark.createDataFrame([("part", "done", 5), ("none", "done", 77), ("none", "running", 99)], "info_source string, status string, end_id bigint")
    return g.initial_cursor(v.part.select(F.lit("part").alias("info_source"), source.alias("id_source"), F.col("p_name").alias("title")), states)


@query("SELECT event_type AS task, CASE WHEN event_type < 'p' THEN 'running' ELSE 'idle' END AS status, CASE WHEN event_type < 'p' THEN max(event_id) ELSE min(event_id) END AS current_id FROM events GROUP BY 1")
def sync_status(v):
    by = v.events.groupBy(F.col("event_type").alias("task")).agg(F.max("event_id").alias("current_id"), F.min("event_id").alias("cursor"))
    return g.sync_status(by.select("task"), by.where("task < 'p'").select("task", F.lit("running").alias("status"), "current_id"), by.select("task", "cursor"))


@query("SELECT DISTINCT subject_id AS id FROM {subject_staff} WHERE subject_id % 2 = 0")
def subject_gate(v):
    known = v.subject.where("id % 2 = 0").select("info_source", F.col("id").alias("id_source"))
    return g.subject_gate(v.subject_staff.select(F.col("subject_id").alias("id_source")).distinct(), known, "src_subject").select(F.col("id_source").alias("id"))


@query("""SELECT subject_id, kind, count(*) AS n FROM (SELECT source_id AS subject_id, 'subject' AS kind, target_id AS other FROM {subject_subject} UNION SELECT subject_id, 'person', staff_id FROM {subject_staff} UNION SELECT subject_id, 'person', actor_id FROM {subject_actor} UNION SELECT subject_id, 'character', character_id FROM {subject_character}) x GROUP BY 1, 2""")
def subject_dependents(v):
    people = v.subject_staff.select("subject_id", F.col("staff_id").alias("other")).unionByName(v.subject_actor.select("subject_id", F.col("actor_id").alias("other")))
    return g.subject_dependents({"subject": v.subject_subject.select(F.col("source_id").alias("subject_id"), F.col("target_id").alias("other")), "person": people, "character": v.subject_character.select("subject_id", F.col("character_id").alias("other"))})


@query("SELECT 'line identity' AS rule, concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def audit_identity(v):
    rows = v.lineitem.select(F.col("l_orderkey").alias("info_source"), F.col("l_linenumber").alias("id_source"))
    return a.audit_identity({"line": rows})


KINDS = ("activity", "post", "comment", "review", "collection")


def one_target(table, kinds):
    return f"SELECT '{table} target' AS rule, CAST(id AS STRING) AS key FROM ({{0}}) x WHERE " + " + ".join(f"CAST({k}_id IS NOT NULL AS INT)" for k in kinds) + " <> 1"


#: Rows with no target or two are planted in all but the notifications, which have them.
TARGETED = {
    "notification": ("SELECT * FROM {notification}", KINDS),
    "comment": ("SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE post_id END AS post_id, CASE WHEN id % 11 < 2 THEN id END AS review_id FROM {comment}", ("post", "review")),
    "reaction": ("SELECT id, CASE WHEN target_type = 'post' THEN target_id END AS post_id, CASE WHEN target_type = 'comment' OR id % 13 = 0 THEN target_id END AS comment_id, CASE WHEN target_type = 'activity' THEN target_id END AS activity_id FROM {reaction}", ("post", "comment", "activity")),
    "bookmark": ("SELECT id, post_id, CASE WHEN id % 7 = 0 THEN NULL ELSE review_id END AS review_id, CASE WHEN id % 5 = 0 THEN id ELSE collection_id END AS collection_id FROM {bookmark}", ("post", "review", "collection")),
    "report": ("SELECT id, post_id, CASE WHEN id % 3 = 0 THEN id ELSE comment_id END AS comment_id FROM {report}", ("post", "comment")),
}


@query(" UNION ALL ".join(one_target(name, kinds).format(rows) for name, (rows, kinds) in TARGETED.items()))
def audit_single_target(v):
    out = None
    for name, (rows, kinds) in TARGETED.items():
        source = v.spark.sql(rows, **{name: getattr(v, name)})
        some = a.audit_single_target(source, [f"{k}_id" for k in kinds], name)
        out = some if out is None else out.unionByName(some)
    return out


@query("SELECT 'post type' AS rule, CAST(id AS STRING) AS key FROM {post} WHERE id % 6 = 0")
def audit_post_type(v):
    return a.audit_post_type(v.post.withColumn("post_type", F.when(F.col("id") % 6 == 0, "status").otherwise(F.col("post_type"))))


def watched(v):
    n = F.col("id")
    start = F.when(n % 5 == 0, "").when(n % 5 == 1, "27/07/2026").otherwise("2026-07-28")
    return v.mark.select("id", start.alias("start"), F.when(n % 3 == 0, "2026-07-27").when(n % 3 == 1, "").otherwise("2026-13-01").alias("end"))


@query("SELECT 'start date' AS rule, CAST(id AS STRING) AS key FROM {mark} WHERE id % 5 = 1 UNION ALL SELECT 'end date', CAST(id AS STRING) FROM {mark} WHERE id % 3 = 2 UNION ALL SELECT 'date order', CAST(id AS STRING) FROM {mark} WHERE id % 5 > 1 AND id % 3 = 0")
def audit_watch_dates(v):
    return a.audit_watch_dates(watched(v))


@query("SELECT id, CASE WHEN id % 5 > 1 THEN '2026-07-28' END AS start, CASE WHEN id % 3 = 0 THEN '2026-07-27' END AS \"end\" FROM {mark}")
def cast_watch_dates(v):
    return a.cast_watch_dates(watched(v)).select("id", *text("start", "end"))


@query("SELECT 'negative steps' AS rule, CAST(event_id AS STRING) AS key FROM events WHERE value < 10 UNION ALL SELECT 'status', CAST(event_id AS STRING) FROM events WHERE event_id % 9 = 0")
def audit_sync_counters(v):
    return a.audit_sync_counters(v.events.select(F.col("event_id").alias("id"), (F.col("value") - 10).alias("steps"), F.when(F.col("event_id") % 9 == 0, "odd").otherwise("running").alias("status")), ["steps"])


@query("SELECT 'simple rating' AS rule, CAST(id AS STRING) AS key FROM {mark} WHERE simple_rating + 2 > 5 UNION ALL SELECT 'rating', CAST(id AS STRING) FROM {mark} WHERE rating + 5 > 10 UNION ALL SELECT 'detail', CAST(id AS STRING) FROM {rating_detail} WHERE value + 1 > 10")
def audit_ratings(v):
    return a.audit_ratings(v.mark.withColumn("simple_rating", F.col("simple_rating") + 2).withColumn("rating", F.col("rating") + 5), v.rating_detail.withColumn("value", F.col("value") + 1))


@query("SELECT 'follow self' AS rule, concat(CAST(user_id AS STRING), ':', CAST(user_id AS STRING)) AS key FROM events WHERE user_id = event_id % 100 UNION ALL SELECT 'follow pair', concat(CAST(user_id AS STRING), ':', CAST(event_id % 100 AS STRING)) FROM events GROUP BY user_id, event_id % 100 HAVING count(*) > 1")
def audit_edges(v):
    return a.audit_edges(v.events.select(F.col("user_id").alias("a"), (F.col("event_id") % 100).alias("b")), "a", "b", "follow")


@query("SELECT 'mark of review' AS rule, CAST(id AS STRING) AS key FROM {review} WHERE mark_id % 2 = 1 UNION ALL SELECT 'post of comment', CAST(id AS STRING) FROM {comment} WHERE post_id % 3 = 0")
def audit_orphans(v):
    return a.audit_orphans([("mark of review", v.review, "mark_id", v.mark.where("id % 2 = 0"), "id"), ("post of comment", v.comment, "post_id", v.post.where("id % 3 <> 0"), "id")])


#: The declared unique keys of all tables there are, but for those of `audit_identity`: rule, table, key and the rows it holds for.
#: As in a database, a target that is null repeats nothing.
UNIQUE = [
    ("reaction", "reaction", ["user_id", "target_type", "target_id", "reaction_type"], None),
    ("mark", "mark", ["user_id", "subject_id"], None),
    ("rating detail", "rating_detail", ["mark_id", "key"], None),
    ("tag", "user_tag", ["user_id", "name"], None),
    ("tag of mark", "mark_tag", ["mark_id", "tag_id"], None),
    ("progress", "progress", ["mark_id", "episode_id"], None),
    ("item", "item", ["collection_id", "mark_id"], None),
    ("staff", "subject_staff", ["subject_id", "staff_id", "role"], None),
    ("character", "subject_character", ["subject_id", "character_id", "role"], None),
    ("actor", "subject_actor", ["subject_id", "character_id", "actor_id"], None),
    ("relation", "subject_subject", ["source_id", "target_id", "relation"], None),
    ("calendar", "calendar_subject", ["subject_id"], None),
    *[(f"bookmark of {kind}", "bookmark", ["user_id", f"{kind}_id"], f"{kind}_id IS NOT NULL") for kind in ("post", "review", "collection")],
    ("activity", "activity", ["dedupe_key"], "dedupe_key <> ''"),
    ("follow", "follow", ["follower_id", "following_id"], None),
    ("block", "block", ["user_id", "target_id"], None),
    ("mute", "mute", ["user_id", "target_id"], None),
    ("user of profile", "profile", ["user_id"], None),
    ("nickname", "profile", ["nickname"], None),
    ("name mapping", "name_mapping", ["external_name"], None),
]


def more_than_once(rule, table, keys, where):
    return f"SELECT '{rule}' AS rule, concat_ws(':', {', '.join(f'CAST({k} AS STRING)' for k in keys)}) AS key FROM {{{table}}} WHERE {where or 'TRUE'} GROUP BY {', '.join(keys)} HAVING count(*) > 1"


@query(" UNION ALL ".join(more_than_once(*u) for u in UNIQUE))
def audit_unique_keys(v):
    """Marks, a join of lineitem and orders that six of the tables are made of, are made once, of the columns that their keys
    are made of."""
    v.keep_columns("mark", "id", "user_id", "subject_id")
    return a.audit_unique_keys({rule: (getattr(v, table).where(where or "TRUE"), keys) for rule, table, keys, where in UNIQUE})


def event_stream(v):
    return v.spark.readStream.schema(v.events.schema).parquet(f"{v.sf_dir}/events.parque*")


def run_to_table(v, rows, mode):
    """The last state of a streaming query as a table: each batch writes a version of its own, the last one is read."""
    path, versions = shared_path(v.spark, "stream"), []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        versions.append(f"{path}/{number}")

    jobs.run_available(rows, write, shared_path(v.spark, "progress"), mode)
    return v.spark.read.parquet(*(versions[-1:] if mode == "complete" else versions))


@query("SELECT event_type AS task, user_id AS entity, count(*) AS retry_count FROM events WHERE value < 5 GROUP BY 1, 2")
def stream_errors(v):
    outcomes = event_stream(v).select(F.col("event_type").alias("task"), F.col("user_id").alias("entity"), F.when(F.col("value") < 5, "failed").otherwise("synced").alias("outcome"), "ts")
    return run_to_table(v, jobs.stream_errors(outcomes), "complete").select("task", "entity", "retry_count")


STEP = "(SELECT event_type AS target_type, event_id % 50 AS target_id, ts, event_id, CASE WHEN event_id % 5 < 2 THEN 1 ELSE -1 END AS delta FROM events)"


@query(f"""SELECT target_type, target_id, CAST(max(total) - least(0, min(so_far)) AS BIGINT) AS n FROM (SELECT *, sum(delta) OVER (PARTITION BY target_type, target_id) AS total, sum(delta) OVER (PARTITION BY target_type, target_id ORDER BY ts, event_id) AS so_far FROM {STEP} x) y GROUP BY 1, 2""")
def stream_counters(v):
    step = F.when(F.col("event_id") % 5 < 2, 1).otherwise(-1)
    changes = event_stream(v).select(F.col("event_type").alias("target_type"), (F.col("event_id") % 50).alias("target_id"), "ts", F.col("event_id").alias("id"), step.alias("delta"))
    table = VersionedTable(v.spark, shared_path(v.spark, "counters"), "target_type string, target_id bigint, n bigint", jobs.TARGET, 8)
    jobs.stream_counters(changes, table, shared_path(v.spark, "progress"))
    return table.read()


@query("SELECT DISTINCT concat(event_type, ':', CAST(event_id % 400 AS STRING)) AS dedupe_key FROM events WHERE event_type <> 'view' UNION ALL SELECT '' FROM events WHERE event_type = 'view'")
def stream_dedupe(v):
    rows = event_stream(v).select(F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.col("event_type"), F.lit(":"), (F.col("event_id") % 400).cast("string"))).alias("dedupe_key"))
    return run_to_table(v, jobs.stream_dedupe(rows), "append")


@query("SELECT id, max(title) AS title FROM (SELECT user_id AS id, max(event_type) AS title FROM events GROUP BY 1 UNION ALL SELECT c_custkey, 'a' FROM customer) x GROUP BY 1")
def stream_upsert(v):
    table = VersionedTable(v.spark, shared_path(v.spark, "subjects"), "info_source string, id_source bigint, title string", t.IDENTITY, 8)
    table.create(v.customer.select(F.lit("s").alias("info_source"), F.col("c_custkey").alias("id_source"), F.lit("a").alias("title")))
    landed = event_stream(v).select(F.lit("s").alias("info_source"), F.col("user_id").alias("id_source"), F.col("event_type").alias("title"))
    jobs.stream_upsert(landed.withColumn("place", F.col("title")), table, shared_path(v.spark, "progress"), place=["place"])
    return table.read().select(F.col("id_source").alias("id"), "title")
