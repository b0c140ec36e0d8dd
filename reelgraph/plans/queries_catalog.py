"""Queries of the catalog: lists, pages, search, display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import down
from ..functions.text import similarity
from ..operators import catalog as c
from ..sources.tables import SCHEMAS, read_table
from .registry import query

GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower(%s), '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr(concat('  ', w, ' '), i, 3)))))"


def score_sql(a: str, b: str) -> str:
    x, y = GRAMS % a, GRAMS % b
    shared = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE CAST({shared} AS DOUBLE) / (len({x}) + len({y}) - {shared}) END"


SCORED = f"""SELECT *, greatest({score_sql("title", "'red widget'")}, {score_sql("title_cn", "'red widget'")}) AS score FROM {{subject}} WHERE subject_type IN ('anime', 'galgame')"""
FOUND = f"(SELECT * FROM ({SCORED}) x WHERE contains(upper(title), 'RED WIDGET') OR contains(upper(title_cn), 'RED WIDGET') OR score >= 0.15)"


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def read_tables(v):
    return read_table(v.spark, f"{v.sf_dir}/part.parquet", SCHEMAS["part"])


@query("""SELECT id, title, subject_type, CAST(date AS STRING) AS date FROM {subject}
    WHERE subject_type IN ('anime', 'galgame') AND nsfw = FALSE AND year(date) = 1996 AND month(date) IN (4, 5, 6) AND contains(upper(platform), 'ECO') AND coalesce(total_episodes, eps) BETWEEN 2 AND 40""")
def catalog_filter(v):
    rows = c.catalog_filter(v.subject, nsfw=False, year=1996, season="spring", platform="eco", episodes_min=2, episodes_max=40)
    return rows.select("id", "title", "subject_type", F.col("date").cast("string").alias("date"))


@query("SELECT id, coalesce(total_episodes, eps) AS n FROM {subject} WHERE coalesce(total_episodes, eps) >= 10 AND coalesce(total_episodes, eps) <= 20")
def catalog_episode_range(v):
    return c.episode_range(v.subject, 10, 20).select("id", F.coalesce("total_episodes", "eps").alias("n"))


@query("""SELECT s.id, coalesce(e.n, 0) AS episodes_count, coalesce(t.n, 0) AS staff_count, coalesce(h.n, 0) AS characters_count FROM {subject} s
    LEFT JOIN (SELECT subject_id, count(*) AS n FROM {episode} GROUP BY 1) e ON e.subject_id = s.id LEFT JOIN (SELECT subject_id, count(*) AS n FROM {subject_staff} GROUP BY 1) t ON t.subject_id = s.id
    LEFT JOIN (SELECT subject_id, count(*) AS n FROM {subject_character} GROUP BY 1) h ON h.subject_id = s.id""")
def section_counts(v):
    return c.section_counts(v.subject, v.episode, v.subject_staff, v.subject_character).select("id", "episodes_count", "staff_count", "characters_count")


@query("""SELECT id, title, (SELECT count(*) FROM {subject} WHERE subject_type IN ('anime', 'galgame')) AS total FROM {subject} WHERE subject_type IN ('anime', 'galgame')
    ORDER BY date DESC NULLS FIRST, id DESC LIMIT 16 OFFSET 16""")
def page(v):
    return c.page(c.catalog_filter(v.subject), [down("date"), F.desc("id")], number=2).select("id", "title", "total")


@query(f"SELECT a.id, round({score_sql('a.title', 'a.title_cn')}, 9) AS score FROM {{subject}} a")
def trigram_similarity(v):
    return v.subject.select("id", F.round(similarity(F.col("title"), F.col("title_cn")), 9).alias("score"))


@query(f"SELECT id, title, round(score, 9) AS score FROM {FOUND} y ORDER BY score DESC, updated_minute DESC, id DESC LIMIT 16")
def catalog_search(v):
    return c.catalog_search(v.subject, "red widget").select("id", "title", F.round("score", 9).alias("score"))


@query(f"""SELECT keyword, id, round(max(score), 9) AS score FROM (SELECT k.keyword, s.id, t.title, {score_sql("k.keyword", "t.title")} AS score FROM (VALUES ('red widget'), ('Brand#1 gear'), ('blue'), ('dg'), ('#1'), ('idge')) AS k(keyword)
    CROSS JOIN {{subject}} s JOIN (SELECT id, title FROM {{subject}} UNION SELECT id, title_cn FROM {{subject}}) t ON t.id = s.id) x GROUP BY 1, 2 HAVING max(score) >= 0.15 OR bool_or(contains(upper(title), upper(keyword)))""")
def search_many(v):
    keywords = v.spark.createDataFrame([("red widget",), ("Brand#1 gear",), ("blue",), ("dg",), ("#1",), ("idge",)], "keyword string")
    return c.search_many(v.subject, keywords).select("keyword", "id", F.round("score", 9).alias("score"))


@query("""SELECT source_id AS subject_id, target_id AS other_id, relation, 'outgoing' AS direction, title FROM {subject_subject} JOIN {subject} s ON s.id = target_id
    UNION ALL SELECT target_id, source_id, relation, 'incoming', title FROM {subject_subject} JOIN {subject} s ON s.id = source_id WHERE source_id <> target_id""")
def subject_relations(v):
    return c.subject_relations(v.subject_subject, v.subject).select("subject_id", "other_id", "relation", "direction", "title")


@query("""SELECT c.subject_id, c.character_id, c.role, p.name, coalesce(a.actors, '') AS actors FROM {subject_character} c JOIN {person} p ON p.id = c.character_id
    LEFT JOIN (SELECT subject_id, character_id, string_agg(name, ',' ORDER BY name, actor_id) AS actors FROM {subject_actor} JOIN {staff} s ON s.id = actor_id GROUP BY 1, 2) a ON a.subject_id = c.subject_id AND a.character_id = c.character_id""")
def subject_characters(v):
    rows = c.subject_characters(v.subject_character, v.person, v.subject_actor, v.staff)
    return rows.select("subject_id", "character_id", "role", "name", F.array_join("actors.actor", ",").alias("actors"))


@query("""SELECT subject_id, staff_id, role, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY CASE WHEN role = '監督' THEN 0 WHEN role = '脚本' THEN 2 ELSE 50 END, role, name, staff_id) AS INT) AS rank
    FROM {subject_staff} JOIN {staff} s ON s.id = staff_id""")
def staff_ranked(v):
    return c.ranked(v.subject_staff.withColumnRenamed("staff_id", "person_id"), v.staff, c.STAFF_ROLES).select("subject_id", F.col("person_id").alias("staff_id"), "role", "rank")


@query("""SELECT subject_id, character_id, role, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY CASE WHEN role = '主角' THEN 0 ELSE 2 END, role, name, character_id) AS INT) AS rank
    FROM {subject_character} JOIN {person} p ON p.id = character_id""")
def characters_ranked(v):
    return c.ranked(v.subject_character.withColumnRenamed("character_id", "person_id"), v.person, c.CHARACTER_ROLES).select("subject_id", F.col("person_id").alias("character_id"), "role", "rank")


@query("SELECT subject_id, string_agg(role, ',' ORDER BY role) AS roles FROM (SELECT DISTINCT subject_id, role FROM {subject_staff} WHERE role <> '') x GROUP BY 1")
def staff_roles(v):
    return c.staff_roles(v.subject_staff).select("subject_id", F.array_join("roles", ",").alias("roles"))


@query("SELECT subject_id, id, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY sort ASC NULLS LAST, ep_num ASC NULLS LAST, id) AS INT) AS place FROM {episode} WHERE type = 'EP'")
def subject_episodes(v):
    return c.subject_episodes(v.episode, "EP").select("subject_id", "id", "place")


@query("SELECT subject_id, weekday_en, collection_doing, title FROM {calendar_subject} JOIN {subject} s ON s.id = subject_id ORDER BY weekday_en, collection_doing DESC, title, subject_id")
def calendar_list(v):
    return c.calendar_list(v.calendar_subject, v.subject).select("subject_id", "weekday_en", "collection_doing", "title")


@query("""SELECT weekday, weekday_en, string_agg(CAST(subject_id AS STRING), ',' ORDER BY collection_doing DESC, title, subject_id) AS subjects, count(*) AS n
    FROM {calendar_subject} JOIN {subject} s ON s.id = subject_id JOIN (VALUES ('Monday', 1), ('Tuesday', 2), ('Wednesday', 3), ('Thursday', 4), ('Friday', 5), ('Saturday', 6), ('Sunday', 7)) AS d(name, weekday) ON name = weekday_en GROUP BY 1, 2""")
def calendar_grouped(v):
    rows = c.calendar_grouped(v.calendar_subject, v.subject)
    return rows.select(F.col("weekday").cast("int").alias("weekday"), "weekday_en", F.array_join(F.transform("entries", lambda e: e["subject_id"].cast("string")), ",").alias("subjects"), F.size("entries").cast("long").alias("n"))


@query("""SELECT id, concat_ws(' / ', CASE WHEN coalesce(nullif(total_episodes, 0), nullif(eps, 0)) IS NOT NULL THEN concat(CAST(coalesce(nullif(total_episodes, 0), nullif(eps, 0)) AS STRING), '话') WHEN coalesce(volumes, 0) <> 0 THEN concat(CAST(volumes AS STRING), '卷') END,
    CASE WHEN date IS NOT NULL THEN concat(CAST(year(date) AS STRING), '年', CAST(month(date) AS STRING), '月', CAST(day(date) AS STRING), '日') END, CASE WHEN id % 4 = 0 THEN brand END) AS meta FROM {subject}""")
def display_meta(v):
    box = F.when(F.col("id") % 4 == 0, F.array(F.struct(F.lit("Director").alias("key"), F.array(F.lit(" "), F.col("brand")).alias("value")), F.struct(F.lit("原作").alias("key"), F.array("brand").alias("value"))))
    rows = v.subject.withColumn("infobox", F.coalesce(box, F.array().cast("array<struct<key:string,value:array<string>>>")))
    return c.display_meta(rows).select("id", "meta")


@query("""SELECT id, coalesce(nullif(title_cn, ''), nullif(title, ''), 'Untitled') AS display_title, coalesce(CAST(year(date) AS INT), -1) AS year, subject_type, concat(CASE WHEN id % 3 = 0 THEN '' ELSE concat('t', id_source) END, '|', CASE WHEN id % 6 = 0 THEN '' ELSE concat('o', id_source) END) AS images, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 6 = 0 THEN '' ELSE concat('o', id_source) END ELSE concat('t', id_source) END AS poster,
    CASE WHEN length(trim(content)) <= 180 THEN trim(content) ELSE concat(rtrim(substr(trim(content), 1, 177)), '...') END AS excerpt, concat(info_source, ':', id_source) AS source, concat(CASE WHEN id % 4 = 0 THEN 'series' ELSE 'single' END, ':', coalesce(CAST(coalesce(nullif(total_episodes, 0), eps) AS STRING), '-'), ':', coalesce(CAST(volumes AS STRING), '-')) AS content
    FROM (SELECT s.*, coalesce(d.text, '') AS content FROM {subject} s LEFT JOIN documents d ON d.doc_id = s.id) x""")
def catalog_cards(v):
    image = lambda name, n: F.when(F.col("id") % n == 0, "").otherwise(F.concat(F.lit(name), "id_source"))
    rows = v.subject.join(v.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("description")), "id", "left").withColumns({"image_thumbnail": image("t", 3), "image_original": image("o", 6), "series": F.col("id") % 4 == 0})
    cards = c.catalog_cards(rows.withColumns({"title": F.col("title_cn"), "title_cn": F.col("title")})).fillna(-1, ["year"])
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("-"))
    content = F.concat_ws(":", F.when(F.col("content.series"), "series").otherwise("single"), text("content.episodes"), text("content.volumes"))
    return cards.select("id", "display_title", "year", "subject_type", F.concat_ws("|", "images.thumbnail", "images.original").alias("images"), "images.poster", "excerpt", F.concat_ws(":", "source.provider", "source.id").alias("source"), content.alias("content"))


SORTED = {"-updated_at": "updated_minute DESC, id DESC", "updated_at": "updated_minute, id DESC", "-date": "date DESC NULLS FIRST, id DESC", "date": "date ASC NULLS LAST, id DESC", "title": "title, id DESC", "-title": "title DESC, id DESC", "created_at": "brand, id DESC", "-created_at": "brand DESC, id DESC", "rating": "updated_minute DESC, id DESC"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS sorted, id, CAST(place AS INT) AS place FROM (SELECT id, row_number() OVER (ORDER BY {order}) AS place FROM {{subject}} WHERE subject_type IN ('anime', 'galgame') AND nsfw = FALSE) x WHERE place BETWEEN 11 AND 20" for name, order in SORTED.items()))
def catalog_list(v):
    rows = v.subject.withColumnsRenamed({"updated_minute": "updated_at"}).withColumn("created_at", F.col("brand"))
    out = [c.catalog_list(rows, name, 2, 10, nsfw=False).select(F.lit(name).alias("sorted"), "id", "place") for name in SORTED]
    return reduce(DataFrame.unionByName, out)


@query("""SELECT number, total, coalesce(ids, '') AS ids FROM (SELECT count(*) AS total FROM {subject} WHERE subject_type IN ('anime', 'galgame')) t CROSS JOIN (VALUES (2), (100000)) AS p(number)
    LEFT JOIN (SELECT 2 AS number, string_agg(CAST(id AS STRING), ',' ORDER BY date DESC NULLS FIRST, id DESC) AS ids FROM (SELECT id, date, row_number() OVER (ORDER BY date DESC NULLS FIRST, id DESC) AS n FROM {subject} WHERE subject_type IN ('anime', 'galgame')) x WHERE n BETWEEN 17 AND 32) y USING (number)""")
def page_result(v):
    rows = c.catalog_filter(v.subject).select("id", "date")
    pages = [c.page_result(rows, [down("date"), F.desc("id")], n) for n in (2, 100_000)]
    return pages[0].unionByName(pages[1]).select("number", "total", F.array_join(F.transform("results", lambda r: r["id"].cast("string")), ",").alias("ids"))
