"""Inputs derived from the given tables so that every rule has rows that trigger it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions import tags as G
from linkshelf.operators.ordered import last_by
from linkshelf.operators.registry import classified_captures
from linkshelf.session import configure

_NAMES = C.CATEGORIES + ["Unknown A", "Unknown B"]


def pick(values: list, index: Column) -> Column:
    """``values[index]`` (0-based)."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def video_url(source: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("https://v.example.com/"), source, F.lit("/"), doc_id.cast("string"))


class Tables:
    """The given tables and the ones derived from them, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        configure(spark)
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "events":
            df = df.withColumn("ts", F.col("ts").cast("timestamp"))
        return df

    @cached_property
    def captures(self) -> DataFrame:
        pages = self.read("pages").select("page_id", "url")
        base = F.rtrim(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/"))
        bases = pages.select(F.col("page_id").alias("base_id"), base.alias("base"))
        rows = pages.withColumn("base_id", F.col("page_id") - F.col("page_id") % 5).join(bases, "base_id")
        host = F.regexp_extract("base", "^[a-z]+://[^/]*", 0)
        kind, b = F.col("page_id") % 5, F.col("base")
        line = (
            F.when(kind == 0, b)
            .when(kind == 1, F.concat(b, F.lit("?utm_source=x&IGSH=y")))
            .when(kind == 2, F.concat(F.lit("  "), F.upper(host), F.substr(b, F.length(host) + 1)))
            .when(kind == 3, F.concat(b, F.lit("/?a=1&_t=z")))
            .otherwise(F.concat(F.lit("not a url "), F.col("page_id").cast("string"), F.lit("/")))
        )
        return rows.select(F.col("page_id").alias("seq"), line.alias("line"))

    @cached_property
    def capture_urls(self) -> DataFrame:
        return classified_captures(self.captures)

    @cached_property
    def known(self) -> DataFrame:
        return self.capture_urls.filter((F.col("seq") % 15 == 0) & F.col("valid")).select("url").distinct()

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def video_metadata(self) -> DataFrame:
        d, text = F.col("doc_id"), F.col("text")
        title = (
            F.when(d % 7 == 0, "Top 10 places to see").when(d % 7 == 1, "my favourite songs").when(d % 7 == 2, "")
            .otherwise(text)
        )
        described = F.concat(text, F.lit(" #"), F.col("lang"), F.lit(" #"), F.col("source"), F.lit(" #"), F.col("lang"))
        return self.documents.select(
            "doc_id", video_url(F.col("source"), d).alias("url"), title.alias("title"),
            F.when(d % 9 == 0, F.concat(F.lit("#"), F.col("source"))).otherwise(described).alias("description"),
            F.when(d % 11 != 0, F.col("source")).alias("creator"), F.array("lang", "source", F.lit("")).alias("tags"),
            ((d * 7) % 240).cast("double").alias("duration"), (d % 13 == 0).alias("is_carousel"), "text", "lang", "source",
        )

    @cached_property
    def cards(self) -> DataFrame:
        d = F.col("doc_id")
        rows = self.documents.join(self.read("labels").select("doc_id", "quality"), "doc_id", "left")
        rows = rows.withColumn("category", F.when(d % 28 == 0, "Music").otherwise(pick(_NAMES, d % 14)))
        rows = rows.withColumn(
            "folder", F.when(d % 17 == 0, F.lit(C.MANUAL_REVIEW_FOLDER)).otherwise(G.folder_for(F.col("category")))
        )
        ending = F.when(d % 50 == 7, " Hub.md").when(d % 50 == 8, " Map notes.md").otherwise(".md")
        rows = rows.withColumn("name", F.concat(d.cast("string"), ending))
        statuses = ["inbox", "kept", "tossed", "promoted", "manual-review", "ready", "To Watch", "archived", None]
        return rows.select(
            "doc_id", video_url(F.col("source"), d).alias("url"), "category", "folder", "name",
            F.concat(F.lit("3 - Resources/"), "folder", F.lit("/"), "name").alias("path"),
            pick(statuses, d % 9).alias("status"),
            pick([None, "ready", "to-watch", "manual-review", "archived"], d % 5).alias("stage"),
            F.timestamp_micros((F.lit(1706659200) - d * 3600) * 1_000_000).alias("ctime"),
            F.array(F.lit("old-library"), F.lit("category/recipes-&-food"), F.col("lang")).alias("tags"),
            F.when(d % 3 == 1, 0.0).when(d % 3 == 2, 0.8).alias("confidence"),
            F.col("source").alias("creator"), F.col("text").alias("summary"), "text", "quality",
        )

    @cached_property
    def scores(self) -> DataFrame:
        d = F.col("doc_id")
        share = lambda k: ((d * k) % 100) / 100.0
        ids = self.documents.select("doc_id")
        first = ids.filter(d % 10 != 3).select(
            "doc_id", F.lit(0).alias("pos"), pick(_NAMES, (d * 5) % 16).alias("cat"),
            share(37).alias("confidence"), share(53).alias("needs_visuals"),
        )
        again = ids.filter(d % 10 == 4).select(
            "doc_id", F.lit(1).alias("pos"), pick(_NAMES, (d * 3) % 16).alias("cat"),
            share(41).alias("confidence"), share(59).alias("needs_visuals"),
        )
        return first.unionByName(again)

    @cached_property
    def best_scores(self) -> DataFrame:
        return last_by(self.scores, ["doc_id"], "pos", ["cat", "confidence", "needs_visuals"])

    @cached_property
    def _event_urls(self) -> DataFrame:
        docs = self.documents.select(F.col("doc_id").alias("user_id"), "source")
        return self.read("events").join(docs, "user_id").withColumn("url", video_url(F.col("source"), F.col("user_id")))

    @cached_property
    def ledger(self) -> DataFrame:
        return self._event_urls.select(
            F.col("event_id").alias("seq"), "url", pick(["carded", "tossed", "merged"], F.col("event_id") % 3).alias("event")
        )

    @cached_property
    def analysis_state(self) -> DataFrame:
        e = F.col("event_id")
        statuses = ["done", "failed-retryable", "unavailable", "needs-review", "manual-review"]
        return self._event_urls.select(
            e.alias("seq"), "url", pick(statuses, e % 5).alias("status"), pick(["2", "3"], e % 2).alias("prompt_version"),
            (e % 4).alias("attempts"), "ts",
        )

    @cached_property
    def latest_state(self) -> DataFrame:
        return last_by(self.analysis_state, ["url"], "seq", ["status", "prompt_version", "attempts"])

    @cached_property
    def request_log(self) -> DataFrame:
        e = F.col("event_id")
        return self.read("events").select(
            e.alias("seq"), F.timestamp_micros((F.lit(1704094200) + e * 5) * 1_000_000).alias("ts"),
            F.concat(F.lit("K"), (F.col("user_id") % 4).cast("string")).alias("key"),
            F.when(F.col("event_type").isin("click", "view"), "llm").otherwise("classifier").alias("provider"),
            F.floor(F.col("value") * 100).alias("in_tokens"), F.floor(F.col("value") * 10).alias("out_tokens"),
        )

    @cached_property
    def cues(self) -> DataFrame:
        t = F.col("turn")
        return self.read("conversations").select(
            F.col("conv_id").alias("video"), t.alias("pos"), (t * 4.0).alias("start_s"),
            F.concat(F.lit("line "), (t - F.when(t % 3 == 1, 1).otherwise(0)).cast("string")).alias("line"),
        )

    @cached_property
    def segments(self) -> DataFrame:
        e = F.col("event_id")
        return self.read("events").select(
            e.alias("seq"), F.col("user_id").alias("clip"), (e % 600).cast("double").alias("start_s"),
            (e % 600 + F.col("value") / 100).alias("end_s"), ((e % 10) / 10.0).alias("no_speech"),
            (-(e % 4) * F.lit(0.6)).alias("logprob"), F.col("event_type").alias("text"), F.lit(600.0).alias("duration"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("video"), F.col("l_linenumber").cast("bigint").alias("position"),
            pick(C.ITEM_KINDS, F.col("l_partkey") % 12).alias("kind"),
            F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("name"),
        )

    @cached_property
    def travel_cards(self) -> DataFrame:
        s = F.col("s_suppkey")
        nations = self.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        return self.read("supplier").join(nations, "s_nationkey").select(
            s.alias("id"), F.col("n_name").alias("location_name"), (s % 8).alias("weight"),
            F.when(s % 2 == 1, "#000000").otherwise(G.weight_color(s % 8)).alias("color"),
            F.concat(F.lit("card "), s.cast("string"), pick([".md", " Hub.md", " Map.md"], F.when(s % 9 < 2, s % 9 + 1).otherwise(0))).alias("name"),
            F.when(s % 3 == 0, 1.5).alias("lat"), F.when(s % 3 == 0, 2.5).alias("lon"),
        )

    @cached_property
    def gazetteer(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.read("nation").filter(k % 4 != 0).select(
            F.col("n_name").alias("place"), F.when(k == 7, 200.0).otherwise(k * 5.0 - 60).alias("lat"),
            (k * 10.0 - 120).alias("lon"),
        )

    @cached_property
    def fetch_log(self) -> DataFrame:
        d = F.col("doc_id")
        fixed = pick(["HTTP Error 429", "Private video ... HTTP Error 429", "timed out", "404: Not Found"], d % 5)
        return self.documents.select(
            "doc_id", video_url(F.col("source"), d).alias("url"), F.coalesce(fixed, "text").alias("stderr")
        )

    @cached_property
    def redirects(self) -> DataFrame:
        pages = self.read("pages").filter(F.contains("url", F.lit("//m.")))
        return pages.select(
            F.col("url").alias("short"), F.concat(F.replace("url", F.lit("//m."), F.lit("//")), F.lit("?x=1")).alias("target")
        )

    @cached_property
    def movies(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.read("part").select(
            p.alias("seq"), F.col("p_type").alias("title"), F.concat(F.lit("https://v.example.com/p/"), p.cast("string")).alias("url")
        )

    @cached_property
    def taxonomy(self) -> DataFrame:
        return G.taxonomy(self.spark)


def joined(col: Column, sep: str = "|") -> Column:
    """An array as text, so that results compare without an array type."""
    return F.array_join(col.cast("array<string>"), sep)
