"""Batched model scoring: payloads, the scorer hook, validation and reconciliation."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.tags import known_category
from linkshelf.functions.text import body_context, first_of, heading_title, text_or_blank
from linkshelf.operators.ordered import last_by, packed, row_numbers
from linkshelf.operators.sets import union_all
from linkshelf.session import materialize
from linkshelf.sources.writers import read_or_empty

RESPONSE = "results array<struct<i:int,cat:string,summ:string>>"
RESULT_ROWS = "array<struct<i:int,cat:string,summ:string>>"


def batch_payloads(packed: DataFrame) -> DataFrame:
    """One compact JSON payload ``[{i,t,c}]`` per request batch."""
    item = F.struct(
        F.col("i"),
        F.left(text_or_blank(F.col("title")), F.lit(C.TITLE_CHARS)).alias("t"),
        F.left(text_or_blank(F.col("description")), F.lit(C.CAPTION_CHARS)).alias("c"),
    )
    rows = packed.groupBy("block", "batch").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("n_items")
    )
    return rows.select("block", "batch", "n_items", F.to_json("items").alias("payload"))


#: Characters of texts and answers that a worker holds as Python strings before it hands on a piece of its rows.
PIECE_CHARS = 1 << 20


def score_batches(
    batches: DataFrame, scorer: Callable[[str], str | None], text: str = "payload", keep: list[str] | None = None,
) -> DataFrame:
    """Call ``scorer(payload) -> response text`` once per row; adds ``response`` and ``error``.

    This is the only place Python sees data. A scorer that raises leaves its batch unanswered
    with the error text, so the batch stays queued. Rows keep the columns ``keep``, all by default. A worker hands on its answers
    in pieces of ``PIECE_CHARS``, or one row, so its memory doesn't grow with the rows of an Arrow batch.
    """
    from pyspark.sql import types as T

    kept = batches.columns if keep is None else keep
    schema = T.StructType(
        [batches.schema[c] for c in kept] + [T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]
    )
    limit = PIECE_CHARS

    def run(arrow):
        import pyarrow as pa

        def piece(rows, answers, errors):
            told = [pa.array(answers, pa.string()), pa.array(errors, pa.string())]
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *told], [*kept, "response", "error"])

        for batch in arrow:
            values, low, chars, answers, errors = batch.column(text), 0, 0, [], []
            for at in range(batch.num_rows):
                value = values[at].as_py()
                try:
                    answers.append(scorer(value))
                    errors.append(None)
                except Exception as exc:  # the caller's scorer may fail in any way
                    answers.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
                chars += len(value or "") + len(answers[-1] or "")
                if chars >= limit or at + 1 == batch.num_rows:
                    yield piece(batch.slice(low, at + 1 - low), answers, errors)
                    low, chars, answers, errors = at + 1, 0, [], []
            del batch, values  # not held beside the next one

    return batches.mapInArrow(run, schema)


STORED = "payload_hash string, response string"


def scored_once(batches: DataFrame, scorer: Callable[[str], str | None], store: str) -> DataFrame:
    """``batches`` with ``response`` and ``error``; a payload answered before is taken from ``store``, not asked again.

    ``store`` is a folder of answers by payload hash that lives from run to run. Every answer of this run is added to
    it, also those of batches that stay queued behind a failed one. Payloads that failed are asked again next time.
    """
    spark = batches.sparkSession
    hashed = batches.withColumn("payload_hash", F.sha2("payload", 256))
    stored = read_or_empty(spark, store, STORED).groupBy("payload_hash").agg(F.max("response").alias("response"))
    asked = hashed.join(stored.select("payload_hash"), "payload_hash", "left_anti").select("payload_hash", "payload").dropDuplicates(["payload_hash"])
    new = materialize(score_batches(asked, scorer, keep=["payload_hash"]), "asked")
    known = union_all(stored.withColumn("error", F.lit(None).cast("string")), new)
    told = materialize(hashed.join(known, "payload_hash").drop("payload_hash"), "answers")
    new.filter(F.col("error").isNull() & F.col("response").isNotNull()).select("payload_hash", "response").write.mode("append").parquet(store)
    return told


def scored_in_waves(batches: DataFrame, scorer: Callable[[str], str | None], store: str, first: int = 16, growth: int = 4) -> DataFrame:
    """``scored_once`` in waves of growing size along ``(block, batch)``: nothing is asked in waves after a failing one.

    A wave's answers are in ``store`` before the next wave starts, so that a failure costs the rest of its own wave at most.
    The first wave is ``first`` batches, each later one ``growth`` times the one before: their number grows with
    the logarithm of the batches. Batches not asked are not returned; they stay queued. A batch fails with an error or an
    answer that isn't valid.
    """
    numbered = materialize(row_numbers(batches, [], ["block", "batch"], "__number", block=10), "numbered")
    total, done, size, waves = numbered.agg(F.max("__number")).first()[0] or 0, 0, first, []
    while not waves or done < total:
        wave = numbered.filter((F.col("__number") > done) & (F.col("__number") <= done + size)).drop("__number")
        waves.append(scored_once(wave, scorer, store))
        if not validated(waves[-1]).filter("error is not null or problem is not null").isEmpty():
            break
        done, size = done + size, size * growth
    return union_all(*waves)


def extraction_records(scored: DataFrame, record: str) -> DataFrame:
    """Adds the typed record ``r`` and ``problem``: 'error' when the scorer raised, 'invalid' when its answer can't be
    read or its confidence is out of bounds. No row is dropped: one with a problem goes to manual review."""
    r = F.from_json("response", record)
    problem = F.when(F.col("error").isNotNull(), "error").when(r.isNull() | ~bounded_confidence(r["confidence"]), "invalid")
    return scored.withColumn("problem", problem).withColumn("r", F.when(problem.isNull(), r))


def rule_scorer(keywords: dict[str, str] | None = None, default: str = C.DEFAULT_CATEGORY) -> Callable[[str], str]:
    """Deterministic scorer: the first keyword found in title or caption picks the category."""
    table = keywords or {
        "travel": "Travel", "places": "Travel", "song": "Saved Music", "recipe": "Recipes & Food",
        "workout": "Fitness & Health", "code": "Tech & Coding", "movie": "Movies & Shows",
    }

    def score(payload: str) -> str:
        results = []
        for item in json.loads(payload):
            text = f"{item.get('t') or ''} {item.get('c') or ''}".lower()
            category = next((c for word, c in table.items() if word in text), default)
            results.append({"i": item["i"], "cat": category, "summ": " ".join(text.split()[:8])})
        return json.dumps({"results": results})

    return score


def validated(responses: DataFrame) -> DataFrame:
    """Adds ``results`` and ``problem`` ('empty', 'invalid' or NULL) to scored batches."""
    text = text_or_blank(F.col("response"))
    # The array is declared twice: typed, and as raw objects that show which keys are missing.
    parsed = F.from_json(text, RESPONSE)["results"]
    raw = F.from_json(text, "results array<map<string,string>>")["results"]
    incomplete = F.exists(
        F.coalesce(raw, F.array().cast("array<map<string,string>>")),
        lambda m: m["i"].try_cast("int").isNull() | m["cat"].isNull() | m["summ"].isNull(),
    )
    problem = F.when(text == "", "empty").when(parsed.isNull() | raw.isNull() | incomplete, "invalid")
    return responses.withColumn("problem", problem).withColumn("results", F.when(problem.isNull(), parsed))


def bounded_confidence(confidence: Column) -> Column:
    """Valid confidences lie in [0, 1]; anything else invalidates the record."""
    return F.coalesce(~F.isnan(confidence) & confidence.between(0.0, 1.0), F.lit(False))


def stop_at_first_failure(batches: DataFrame, failed: Column) -> DataFrame:
    """Adds ``committed``: batches before the first failing one. It and all later ones stay queued."""
    at = F.struct("block", "batch")
    first = batches.agg(F.min(F.when(failed, at)).alias("first_failed")).scalar()
    return batches.withColumn("committed", F.coalesce(at < first, F.lit(True)))


def answers(responses: DataFrame) -> DataFrame:
    """One row per ``(block, batch, i)``; a repeated ``i`` keeps its last answer."""
    rows = responses.select("block", "batch", F.posexplode("results").alias("pos", "r")).select(
        "block", "batch", "pos", "r.i", "r.cat", "r.summ"
    )
    return last_by(rows, ["block", "batch", "i"], "pos", ["cat", "summ"])


def reconciled(packed: DataFrame, answered: DataFrame) -> DataFrame:
    """Every input row with its answer, defaulted where the model gave none; extra answers drop."""
    joined = packed.join(answered, ["block", "batch", "i"], "left")
    missing = F.col("cat").isNull()
    return joined.withColumn("category", F.when(missing, F.lit(C.DEFAULT_CATEGORY)).otherwise(F.col("cat"))).withColumn(
        "summary", F.when(missing, F.lit(C.DEFAULT_SUMMARY)).otherwise(F.col("summ"))
    ).drop("cat", "summ")


def enrichment_source(cards: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Title, description and tags for re-scoring a card.

    A card found in the snapshot takes everything from it; otherwise both texts are mined
    from the card body. ``snapshot`` has one row per URL.
    """
    snap = snapshot.select(
        "url", F.col("title").alias("s_title"), F.col("description").alias("s_description"), F.col("tags").alias("s_tags"),
        F.lit(True).alias("hit"),
    )
    hit = F.coalesce("hit", F.lit(False))
    title = F.when(hit, F.col("s_title")).otherwise(heading_title(F.col("body"), F.lit("Unknown Title")))
    return cards.join(snap, "url", "left").select(
        *cards.columns,
        hit.alias("from_snapshot"),
        first_of(title, F.lit("Unknown Title")).alias("title"),
        F.when(hit, F.col("s_description")).otherwise(body_context(F.col("body"))).alias("description"),
        F.coalesce(F.when(hit, F.col("s_tags")), F.array().cast("array<string>")).alias("tags_in"),
    )


def parsed_answers(answers_json: Column, tag_threshold: float = C.TAG_THRESHOLD) -> Column:
    """Typed record from a classifier's answer object; missing answers stay NULL."""
    kinds = "map<string,struct<choice:string,confidence:double,score:double,noul:double>>"
    m = F.from_json(answers_json, kinds)

    def of(key: str) -> Column:
        return F.try_element_at(m, F.lit(key))

    def choice(key: str) -> Column:
        return F.nullif(of(key)["choice"], F.lit(""))

    def confidence(key: str) -> Column:
        return F.when(choice(key).isNotNull(), F.coalesce(of(key)["confidence"], F.lit(0.0))).otherwise(0.0)

    tagged = F.filter(
        F.map_entries(m), lambda e: F.startswith(e["key"], F.lit("tag::")) & (e["value"]["noul"] >= tag_threshold)
    )
    return F.struct(
        choice("category").alias("category"),
        confidence("category").alias("category_confidence"),
        choice("media_shape").alias("media_shape"),
        confidence("media_shape").alias("media_shape_confidence"),
        of("relevance")["score"].alias("relevance"),
        F.transform(tagged, lambda e: F.substr(e["key"], F.lit(6))).alias("tags"),
        of("needs_visuals")["noul"].alias("needs_visuals"),
    )


def merged_classification(df: DataFrame) -> DataFrame:
    """Classifier over summary, for rows with ``c_*`` classifier columns beside the analysis.

    ``c_present`` false leaves the row unchanged. A confident category overrides and pushes
    the old one to the secondary list; an unconfident disagreement flags the row.
    """
    sure = F.col("c_confidence") >= C.CLASSIFIER_MIN_CONFIDENCE
    present = F.coalesce("c_present", F.lit(False))
    usable = present & F.coalesce(known_category(F.col("c_category")), F.lit(False))
    differs = ~F.col("c_category").eqNullSafe(F.col("category"))
    override = usable & sure & differs
    push = override & (text_or_blank(F.col("category")) != "") & ~F.array_contains("secondary", F.col("category"))
    shape_ok = present & F.coalesce(F.col("c_shape").isin(C.MEDIA_SHAPES), F.lit(False)) & (
        F.col("c_shape_confidence") >= C.CLASSIFIER_MIN_CONFIDENCE
    )
    return df.withColumns({
        "secondary": F.when(push, F.array_append("secondary", F.col("category"))).otherwise(F.col("secondary")),
        "recategorize": F.when(override, F.lit(True)).otherwise(F.col("recategorize")),
        "flagged": usable & ~sure & differs,
        "relevance": F.when(present, F.col("c_relevance")).otherwise(F.col("relevance")),
        "content_tags": F.when(present, F.col("c_tags")).otherwise(F.col("content_tags")),
        "media_shape": F.when(shape_ok, F.col("c_shape")).otherwise(F.col("media_shape")),
        "category": F.when(override, F.col("c_category")).otherwise(F.col("category")),
    })


def enrichment_batches(cards: DataFrame, order: str) -> DataFrame:
    """Cards in request batches of ten: adds ``block, batch`` and ``item_id``, the place in the batch as text."""
    rows = packed(cards, order, C.ENRICH_BATCH_SIZE)
    return rows.withColumn("item_id", F.col("i").cast("string")).drop("i")


def matched_enrichment(batched: DataFrame, answered: DataFrame) -> DataFrame:
    """Batched cards with the answer to their item; ``skipped`` where the model gave none, and the card stays as it is."""
    given = answered.withColumn("__given", F.lit(True))
    rows = batched.join(given, ["block", "batch", "item_id"], "left")
    return rows.withColumn("skipped", F.col("__given").isNull()).drop("__given")
