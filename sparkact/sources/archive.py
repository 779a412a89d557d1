"""JSON sources and sinks: chat archives, trace lines, timeline and report exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("1", "1.0")
MAX_TEXT_BYTES = 65_536
MOST_FILES = 100_000  # whose last lines are broadcast; those of more are joined by a shuffle

MESSAGE = "struct<id:string,type:string,sender:string,createdAt:string,text:string,media:string,renderType:string,reference:struct<messageId:string,sender:string,createdAt:string>,extra:map<string,string>,mediaRefs:array<struct<kind:string,relativePath:string,label:string,extra:map<string,string>>>>"
ARCHIVE = f"schemaVersion string, exportId string, account struct<stableId:string>, conversation struct<stableId:string>, messages array<{MESSAGE}>"


def safe_member(path: str) -> bool:
    """Whether a manifest's member path is relative and stays inside its folder."""
    return bool(path) and not path.startswith(("/", "\\")) and ":" not in path and ".." not in path.replace("\\", "/").split("/")


def archive_messages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Messages of archive files in their order; a malformed file or an unsupported version fails
    the read, texts over the size limit raise."""
    if bad := [p for p in paths if ".." in p.split("/")]:
        raise ValueError(f"paths that leave their folder: {bad}")
    files = spark.read.schema(ARCHIVE).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    checked = files.withColumn("schemaVersion", F.when(F.col("schemaVersion").isin(*SUPPORTED), F.col("schemaVersion")).otherwise(F.raise_error(F.concat(F.lit("unsupported schema version "), F.coalesce("schemaVersion", F.lit("null"))))))
    rows = checked.select(F.col("schemaVersion").alias("schema_version"), F.col("exportId").alias("export_id"), F.col("account.stableId").alias("account"), F.col("conversation.stableId").alias("conversation"), F.posexplode("messages").alias("source_ordinal", "m"))
    text = F.when(F.octet_length("m.text") > MAX_TEXT_BYTES, F.raise_error(F.lit("text over the size limit"))).otherwise(F.col("m.text"))
    return rows.select("schema_version", "export_id", "account", "conversation", "source_ordinal", F.col("m.id").alias("message_id"), F.col("m.type").alias("kind"), F.col("m.sender").alias("sender"), F.unix_millis(F.to_timestamp("m.createdAt")).alias("created_at_ms"), text.alias("content"))


def trace_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a last line that was cut off is dropped, damage anywhere else raises."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    parsed = lines.withColumn("row", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    last = lines.groupBy("file").agg(F.max("at").alias("last"))  # a row a file and task is all that is shuffled of the lines
    judged = parsed.join(F.broadcast(last) if last.count() <= MOST_FILES else last, "file").withColumn("bad", F.col("row").isNull() | F.col("row._corrupt").isNotNull())
    kept = judged.where(~(F.col("bad") & (F.col("at") == F.col("last")))).withColumn("row", F.when(F.col("bad"), F.raise_error(F.lit("damaged trace line"))).otherwise(F.col("row")))
    return kept.select("row.*").drop("_corrupt")


def write_trace(df: DataFrame, path: str, ts: str = "occurredAt") -> None:
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").json(path)


def timeline_documents(timeline: DataFrame, day: str = "day", with_text: bool = False, text: str = "title", owner: str = "owner") -> DataFrame:
    """One JSON document for each owner and day: version, owner, date, count and the day's records in order."""
    shown = timeline if with_text or text not in timeline.columns else timeline.withColumn(text, F.lit(None).cast("string"))
    names = [c for c in shown.columns if c not in (day, owner)]
    records = F.array_sort(F.collect_list(F.struct(*names)))
    by = shown.groupBy(owner, day).agg(F.count("*").alias("n"), records.alias("records"))
    return by.select(owner, day, F.to_json(F.struct(F.lit(1).alias("version"), F.col(owner).alias("owner"), F.col(day).alias("date"), "n", "records")).alias("document"))
