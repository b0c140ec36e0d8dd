"""Reading tables with fixed schemas, landed payloads, and writing whole new versions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY = ["info_source", "id_source"]
SCHEMAS = {
    "subject": "id string, info_source string, id_source string, subject_type string, title string, title_cn string, date date, image_original string, image_thumbnail string, platform string, description string, nsfw boolean, series boolean, volumes int, eps int, total_episodes int, infobox array<struct<key:string,value:array<string>>>, tags array<string>, created_at timestamp, updated_at timestamp",
    "episode": "id bigint, info_source string, id_source string, title string, type string, ep_num int, sort int, duration bigint, date date, description string, subject_id string",
    "staff": "id bigint, info_source string, id_source string, name string, description string, gender string, birth struct<year:int,month:int,day:int>, type string, career array<string>, image_original string, image_thumbnail string, infobox array<struct<key:string,value:array<string>>>",
    "character": "id bigint, info_source string, id_source string, name string, description string, gender string, birth struct<year:int,month:int,day:int>, type string, blood_type string, image_original string, image_thumbnail string, infobox array<struct<key:string,value:array<string>>>",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}
#: Loose fields are VARIANT: their JSON type is tested, never assumed.
IMAGES = "images variant"
PAYLOADS = {
    "subject": f"id variant, type variant, name variant, name_cn variant, date variant, platform variant, summary variant, {IMAGES}, nsfw variant, series variant, volumes variant, eps variant, total_episodes variant, infobox variant, meta_tags variant, metatag variant",
    "episode": "id variant, name variant, type variant, ep variant, sort variant, duration_seconds variant, airdate variant, `desc` variant",
    "person": f"id variant, name variant, summary variant, gender variant, birth_year variant, birth_month variant, birth_day variant, type variant, career variant, {IMAGES}, infobox variant",
    "character": f"id variant, name variant, summary variant, gender variant, birth_year variant, birth_month variant, birth_day variant, type variant, blood_type variant, {IMAGES}, infobox variant",
}


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Parquet with a declared schema: no inference, only the columns asked for are read."""
    return spark.read.schema(schema).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 64) -> DataFrame:
    """A live database's table in ranges of its key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def parsed(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Payload texts as struct `p`; what isn't a JSON object becomes null, and `rejected` says why: empty, not JSON, not an
    object, or no id (where the payload has one that is no whole number above 0)."""
    # A row that is exploded comes out as a column: a text is parsed once, and not anew for each use of a field.
    lines = lines.select("*", F.explode(F.array(F.try_parse_json(column))).alias("parsed"))
    obj = F.col("parsed")
    fields = [F.try_variant_get(obj, f"$.{name}", "variant").alias(name) for name in T._parse_datatype_string(PAYLOADS[kind]).fieldNames()]
    # What has been parsed and begins with a brace is an object; its schema would be made of all that it holds.
    is_object = F.coalesce(F.col(column).rlike(r"^[ \t\r\n]*\{"), F.lit(False))
    id_ = F.try_variant_get(obj, "$.id", "variant")
    named = F.coalesce((F.schema_of_variant(id_) == "BIGINT") & (F.try_variant_get(id_, "$", "bigint") > 0), F.lit(False))
    why = F.when(F.coalesce(F.trim(F.col(column)), F.lit("")) == "", "empty").when(obj.isNull(), "not JSON").when(~is_object, "not an object").when(id_.isNotNull() & ~named, "no id")
    rows = lines.select(*[c for c in lines.columns if c != "parsed"], why.alias("rejected"), F.explode(F.array(F.struct(*fields))).alias("p"))
    return rows.withColumn("p", F.when(F.col("rejected").isNull(), F.col("p")))


def quarantined(rows: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parsed rows in two: those with a payload, and those without, as they have landed, with the reason. Together they are
    all rows."""
    good = rows.where("rejected IS NULL").drop("rejected", column)
    return good, rows.where("rejected IS NOT NULL").drop("p").withColumnRenamed(column, "landed")


def read_payloads(spark: SparkSession, path: str, kind: str, rejects: str | None = None) -> DataFrame:
    """Landed payload files (a JSON object a line) of a kind as rows (file, p). Lines that can't be used are appended to the
    table at `rejects` (file, landed, reason, at), by reason, and not lost; without a path they raise no error but are left
    out. A file's place is kept with each row of either kind."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    good, bad = quarantined(parsed(lines, kind))
    if rejects:
        bad.select("file", "landed", F.col("rejected").alias("reason"), F.current_timestamp().alias("at")).write.mode("append").partitionBy("reason").parquet(rejects)
    return good


def merge_pages(pages: DataFrame, key: str = "subject_id") -> DataFrame:
    """Elements of `data` of all pages of one subject with their place (page, pos); page bounds are gone."""
    return pages.select(key, "page", F.posexplode("data").alias("pos", "element"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = IDENTITY, keep: tuple[str, ...] = ("id", "created_at"), place: list[str] | None = None) -> DataFrame:
    """Old rows with new ones laid over: unmatched rows stay, the old identity is kept, columns that new lacks stay.

    A batch may have a key several times: `place` names the columns by which the last one wins. Without it the keys of
    `new` must differ, or a key comes out as often as it is there."""
    new = new if place is None else last_by_place(new, keys, place)
    a, b = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("a")), new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("b"))
    both = a.join(b, keys, "full")
    fresh = set(new.columns)

    def column(c: str):
        if c not in fresh:
            return F.col(f"a.{c}")
        if c in keep:
            return F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
        return F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return both.select(*[F.col(c) if c in keys else column(c).alias(c) for c in old.columns])


def last_by_place(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """In a batch the last row of a key wins."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*place)).alias("x")).select(*keys, "x.*")


def missing_stubs(ids: DataFrame, table: DataFrame, key: str = "id_source") -> DataFrame:
    """Identities that are referred to but absent from a table, each once."""
    return ids.select(key).where(F.col(key).isNotNull()).distinct().join(table, key, "left_anti")


def replace_snapshot(old: DataFrame, new: DataFrame, source: str = "info_source") -> DataFrame:
    """The new set in place of the old one for the sources it has; an empty new set changes nothing."""
    sources = new.select(source).distinct()
    return old.join(sources, source, "left_anti").select(*old.columns).unionByName(new)


def write_snapshot(new: DataFrame, path: str, source: str = "info_source") -> bool:
    """Overwrites only the partitions of the sources in `new`; refuses an empty set."""
    if new.isEmpty():
        return False
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)
    return True


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, parent: str, child: str) -> DataFrame:
    """Child rows of the given parents are replaced: new ones once each, at their first position."""
    kept = old.join(parents.select(parent).distinct(), parent, "left_anti").select(parent, child, "place")
    first = new.groupBy(parent, child).agg(F.min("place").alias("first"))
    place = F.row_number().over(Window.partitionBy(parent).orderBy("first", child)) - 1
    return kept.unionByName(first.select(parent, child, place.cast("long").alias("place")))
