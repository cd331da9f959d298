"""Batch and streaming sources.

Text formats carry ``at``, a stable position ``(file, block, row)`` that orders lines without
relying on partition order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkshelf import schemas
from linkshelf.functions import frontmatter
from linkshelf.functions.text import caption_title, first_of, hashtags, strip, text_or_blank
from linkshelf.functions.urls import canonical_url
from linkshelf.operators.ordered import last_by
from linkshelf.sources import files


def _lines(spark: SparkSession, path: str) -> DataFrame:
    where = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.text(path).select("value", where.alias("at"))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture lists: one trimmed, non-blank line per row."""
    return _lines(spark, path).select(strip(F.col("value")).alias("line"), "at").filter(F.length("line") > 0)


def stream_captures(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Capture lists as a stream of files dropped into a folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(strip(F.col("value")).alias("line")).filter(F.length("line") > 0)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays of records. A corrupt file fails the job instead of reading as empty."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def read_table_csv(spark: SparkSession, path: str, schema: str = schemas.CLASSIFIED) -> DataFrame:
    """Headed CSV, every column text; a byte-order mark is dropped."""
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
        .option("encoding", "UTF-8").csv(path).na.fill("")
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Event ledger lines; torn or incomplete lines are skipped."""
    rows = spark.read.schema(schemas.LEDGER + ", _corrupt_record string").json(path)
    good = rows.filter(F.col("_corrupt_record").isNull() & F.col("url").isNotNull() & F.col("event").isNotNull())
    return good.withColumn("url", canonical_url(F.col("url"))).drop("_corrupt_record")


def read_state_log(spark: SparkSession, path: str) -> DataFrame:
    """Analysis state lines with per-field defaults, in file order (``at``)."""
    loose = "url string, status string, prompt_version string, attempts string, last_error string, updated_at string"
    rows = _lines(spark, path).withColumn("r", F.from_json("value", loose))
    attempts = F.coalesce(F.col("r.attempts"), F.lit("0"))
    good = rows.filter(F.col("r.url").isNotNull() & attempts.try_cast("int").isNotNull())
    return good.select(
        canonical_url(F.col("r.url")).alias("url"),
        F.coalesce("r.status", F.lit("pending")).alias("status"),
        F.coalesce("r.prompt_version", F.lit("")).alias("prompt_version"),
        attempts.try_cast("int").alias("attempts"),
        F.col("r.last_error").alias("last_error"), F.col("r.updated_at").alias("updated_at"), "at",
    )


def stream_appended_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture lists as a stream that also sees lines appended to files it has read; a line without its break waits."""
    return files.stream_lines(spark, path).select(strip(F.col("line")).alias("line")).filter(F.length("line") > 0)


def read_cards(spark: SparkSession, root: str) -> DataFrame:
    """Markdown cards at any depth below ``root`` that carry a URL.

    Dot files, dot folders and undecodable notes are skipped. Roots that ``files`` can list are read by it, names with a
    leading underscore too. Of others, Spark's own listing skips such names: they are an error, as they would be lost
    without a word. Rename them, or land them as table rows for ``parsed_cards``.
    """
    if files.known(root):
        return parsed_cards(files.read_notes(spark, root))
    unseen = _underscored(spark, root)
    if unseen:
        raise ValueError(f"Spark's file listing skips {unseen} and names like it")
    notes = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    )
    text = notes.filter(F.is_valid_utf8("content")).select(
        F.try_url_decode("path").alias("path"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content")
    )
    return parsed_cards(text.filter(~F.rlike("path", F.lit(r"/\.[^/]"))))


def _underscored(spark: SparkSession, root: str) -> str | None:
    """A note below ``root``, at any depth, that starts with an underscore or lies in a folder that does."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, above = system.listFiles(top, True), len(system.makeQualified(top).toString())
    while found.hasNext():
        path = found.next().getPath().toString()
        if path.endswith(".md") and "/_" in path[above:]:
            return path
    return None


def parsed_cards(notes: DataFrame) -> DataFrame:
    """Front matter of ``notes(path, content)``: only notes with a URL are cards."""
    content, block = F.col("content"), F.col("block")
    rows = notes.withColumn("block", frontmatter.block_text(content)).filter(block.isNotNull())
    rows = rows.withColumn("fm_state", frontmatter.block_state(block))
    broken = F.col("fm_state") == "broken"
    # A broken block is only read by its url and status lines and must not be rewritten.
    rows = rows.withColumn("parsed", F.when(~broken, frontmatter.entries(block)))
    rows = rows.withColumn("fm", frontmatter.scalars_of(F.col("parsed")))
    field = lambda key: F.when(broken, frontmatter.lenient_value(block, key)).otherwise(F.try_element_at("fm", F.lit(key)))
    rows = rows.withColumns({"raw_url": field("url"), "status": F.coalesce(field("status"), F.lit(""))})
    rows = rows.filter(strip(text_or_blank(F.col("raw_url"))) != "").withColumns({
        "url": canonical_url(F.col("raw_url")),
        "tags": F.try_element_at(frontmatter.lists_of(F.col("parsed")), F.lit("tags")),
        "body": frontmatter.body_text(content),
    })
    return rows.drop("raw_url", "parsed", "block")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Saved-posts export, either a bare list or wrapped in one object."""
    wrapped = f"saved_saved_media array<struct<{_ddl_to_struct(schemas.EXPORT_POST)}>>, {schemas.EXPORT_POST}"
    rows = read_json_array(spark, path, wrapped)
    own = F.when(F.col("label_values").isNotNull(), F.array(F.struct("label_values")))
    return parsed_export(rows.select(F.explode(F.coalesce("saved_saved_media", own)).alias("p")).select("p.label_values"))


def _ddl_to_struct(ddl: str) -> str:
    return ddl.replace("label_values ", "label_values:", 1)


def parsed_export(posts: DataFrame) -> DataFrame:
    """Metadata items from ``posts(label_values)``; posts without a URL are dropped."""
    values = F.col("label_values")

    def last(entries: Column, value) -> Column:
        return F.try_element_at(F.transform(entries, value), F.lit(-1))

    urls = F.filter(values, lambda e: e["label"] == "URL")
    captions = F.filter(values, lambda e: e["label"] == "Caption")
    owners = F.filter(
        values, lambda e: ~e["label"].eqNullSafe(F.lit("URL")) & ~e["label"].eqNullSafe(F.lit("Caption")) & (e["title"] == "Owner")
    )
    names = F.flatten(F.transform(owners, lambda e: F.filter(
        F.coalesce(F.get(e["dict"], F.lit(0))["dict"], F.array().cast("array<struct<label:string,href:string,value:string>>")),
        lambda a: a["label"] == "Username",
    )))
    caption = F.coalesce(last(captions, lambda e: text_or_blank(e["value"])), F.lit(""))
    rows = posts.select(
        F.coalesce(last(urls, lambda e: F.coalesce(e["href"], e["value"], F.lit(""))), F.lit("")).alias("url"),
        caption.alias("description"),
        F.coalesce(last(names, lambda a: a["value"]), F.lit("Unknown")).alias("creator"),
    ).filter(F.col("url") != "")
    return rows.select(
        "url", caption_title(F.col("description"), "Instagram Saved Post").alias("title"), "description",
        hashtags(F.col("description")).alias("tags"), "creator",
    )


def snapshot_lookup(items: DataFrame, order: str) -> DataFrame:
    """Metadata by canonical URL; the last record of a URL wins."""
    keyed = items.withColumn("url", canonical_url(F.col("url")))
    return last_by(keyed, ["url"], order, ["title", "description", "tags", "creator"])


def cached_analysis(cache: DataFrame, version: str) -> DataFrame:
    """Analyses stored by this prompt version whose payload still matches the schema."""
    fresh = cache.filter((F.col("stage") == "analysis") & (F.col("prompt_version") == version))
    parsed = fresh.withColumn("analysis", F.from_json("payload", schemas.ANALYSIS))
    # A record without its required fields is not an analysis.
    needed = ["category", "confidence", "title", "summary"]
    ok = F.lit(True)
    for field in needed:
        ok = ok & F.col(f"analysis.{field}").isNotNull()
    return parsed.filter(ok & F.col("analysis.confidence").between(0.0, 1.0))


def cached_stage(cache: DataFrame, stage: str) -> DataFrame:
    """Latest payload of one prompt-independent stage per URL hash."""
    return last_by(cache.filter(F.col("stage") == stage), ["url_hash"], "version", ["payload"])


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """Raw metadata JSON lines, reading only the fields that are kept."""
    return spark.read.schema(schemas.INFO).json(path)


def metadata_from_info(info: DataFrame) -> DataFrame:
    """Metadata items from raw info with its fallbacks."""
    blank = lambda c: text_or_blank(F.col(c))
    return info.select(
        "url", blank("title").alias("title"), blank("description").alias("description"),
        F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: text_or_blank(t) != "").alias("tags"),
        first_of(F.col("uploader"), F.col("artist"), F.lit("Unknown")).alias("creator"),
        blank("artist").alias("artist"), blank("track").alias("track"), F.lit("").alias("transcript"),
    )


def last_json_object(log: Column) -> Column:
    """Text of the last line of a mixed log that is a JSON object, NULL when none is."""
    lines = F.transform(F.split(strip(text_or_blank(log)), r"\r\n|\n|\r"), strip)
    objects = F.filter(lines, lambda s: F.startswith(s, F.lit("{")) & F.try_parse_json(s).isNotNull())
    return F.try_element_at(objects, F.lit(-1))
