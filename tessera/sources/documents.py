"""Document lists, batches, masters, page labels, crops and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGION_SCHEMA = (
    "name string, saved_at string, page_size array<double>, margins struct<header:string,footer:string,left:string,right:string,skip_pages:map<string,array<string>>>, "
    "regions array<struct<id:string,parent_id:string,label:string,page_num:int,roi_rect:array<double>,page_scope:struct<type:string,page:int,`from`:int,`to`:int,pages:array<int>>,"
    "variant_group:string,exact_match:boolean,scope_only:boolean,presence_only:boolean,pattern_match:boolean,pattern:string,x_tolerance:double,y_tolerance:double,pass_threshold:double,expected_text:string>>, _corrupt_record string"
)


def discovered(spark: SparkSession, folder: str, suffix: str = "pdf", recursive: bool = True) -> DataFrame:
    """(path, size, mtime) of the files with a suffix in either case; contents are not read."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def masters(docs: DataFrame) -> DataFrame:
    """Per batch the master's doc_id and a status: OK, NO MASTER or SEVERAL MASTERS."""
    is_master = F.col("role") == "master"
    m = docs.groupBy("batch_id").agg(F.count_if(is_master).alias("n"), F.min(F.when(is_master, F.col("doc_id"))).alias("master_id"))
    return m.select("batch_id", F.when(F.col("n") == 1, F.col("master_id")).alias("master_id"), F.when(F.col("n") == 1, "OK").when(F.col("n") == 0, "NO MASTER").otherwise("SEVERAL MASTERS").alias("status"))


def translations(docs: DataFrame) -> DataFrame:
    """Documents of batches with one master, but the master, with its id."""
    return docs.join(masters(docs).where("status = 'OK'").select("batch_id", "master_id"), "batch_id").where("doc_id <> master_id")


def in_scope(docs: DataFrame) -> DataFrame:
    """One row per path, in any case, numbered with the master first."""
    one = docs.withColumn("__path", F.lower("path")).withColumn("__n", F.row_number().over(Window.partitionBy("batch_id", F.lower("path")).orderBy(F.desc(F.col("role") == "master"), "path"))).where("__n = 1")
    w = Window.partitionBy("batch_id").orderBy(F.desc(F.col("role") == "master"), "__path")
    return one.withColumn("place", F.row_number().over(w)).drop("__path", "__n")


def language_tag(filename: Column) -> Column:
    """`xx-YY` in a file name, else its first eighteen characters without the suffix."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    tag = F.regexp_extract(stem, r"(?:^|[^A-Za-z])([a-z]{2}-[A-Z]{2})(?:$|[^A-Za-z])", 1)
    return F.when(tag != "", tag).otherwise(F.left(stem, F.lit(18)))


def page_labels(pages: DataFrame) -> DataFrame:
    """pages with label, the page number where there is none."""
    return pages.withColumn("label", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("page_no").cast("string")))


def crop_paths(paths: DataFrame) -> DataFrame:
    """(path, page_no, topic_title) of crop images, from `p###_` or `page_###`; code images left out."""
    name, folder = F.substring_index("path", "/", -1), F.element_at(F.split("path", "/"), -2)
    page = F.coalesce(F.nullif(F.regexp_extract(name, r"^p(\d+)_", 1), F.lit("")), F.nullif(F.regexp_extract(folder, r"^page_(\d+)$", 1), F.lit("")))
    rows = paths.where(~F.lower(name).rlike("barcode|qr")).select("path", page.cast("int").alias("page_no"), F.when(~folder.rlike(r"^page_\d+$"), folder).alias("topic_title"))
    return rows.where("page_no IS NOT NULL")


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """Template JSON files, one row each; a broken file is a row with _corrupt_record."""
    return spark.read.schema(REGION_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)


def template_regions(found: DataFrame) -> DataFrame:
    """One row per region with defaults filled in; unknown keys are dropped by the schema.

    A missing expected text stays null, an empty one stays empty; tolerances left out are inherited.
    """
    r = found.where("_corrupt_record IS NULL").select(F.col("name").alias("template"), F.posexplode("regions").alias("seq", "r")).select("template", "seq", "r.*")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return r.select(
        "template", "seq", F.coalesce("id", F.concat(F.lit("r"), F.col("seq"))).alias("id"), "parent_id", F.coalesce("label", F.concat(F.lit("Region "), F.col("seq") + 1)).alias("label"),
        F.coalesce("page_num", F.lit(1)).alias("page_num"), "roi_rect", F.coalesce("page_scope.type", F.lit("single")).alias("scope"), F.col("page_scope.from").alias("from"), F.col("page_scope.to").alias("to"), F.col("page_scope.pages").alias("pages"),
        F.nullif("variant_group", F.lit("")).alias("variant_group"), flag("exact_match"), flag("scope_only"), flag("presence_only"), flag("pattern_match"), F.nullif("pattern", F.lit("")).alias("pattern"), "x_tolerance", "y_tolerance", "pass_threshold", "expected_text",
    )


def write_templates(regions: DataFrame, folder: str) -> None:
    """Regions back to one JSON object per template."""
    own = [c for c in regions.columns if c not in ("template", "seq")]
    packed = regions.groupBy(F.col("template").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*own).alias("r")))), lambda s: s["r"]).alias("regions"))
    packed.withColumn("saved_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(folder)
