"""The card catalogue: work lists, naming, place weights, boards, triage and folder reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.tags import canonical_category, coordinates_ok, folder_for, replace_category_tag, weight_color
from linkshelf.functions.text import folder_segment, project_name, squeeze, strip, text_or_blank
from linkshelf.operators.ordered import row_numbers, running_sums
from linkshelf.operators.sets import union_all

# --- predicates -------------------------------------------------------------------


def _ends_with_any(name: Column, suffixes: list[str]) -> Column:
    out = F.lit(False)
    for suffix in suffixes:
        out = out | F.endswith(name, F.lit(suffix))
    return out


def is_board(name: Column) -> Column:
    """Hub, board and map notes, which are not cards."""
    return _ends_with_any(name, C.BOARD_SUFFIXES)


def is_not(value: Column, word: str) -> Column:
    """``!=`` that is true for a missing value."""
    return ~value.eqNullSafe(F.lit(word))


def in_folder(folder: Column, root: str) -> Column:
    """The folder itself or any folder below it."""
    return (folder == root) | F.startswith(folder, F.lit(root.rstrip("/") + "/"))


def in_work_list(rel_path, url, status, is_child, *, folder: str | None = None, only_url: str | None = None,
                 include: list[str] | None = None, skip_statuses: list[str] | None = None) -> Column:
    """Cards to re-analyse. Folder options are plain string prefixes of the relative path."""
    skip = [s.lower() for s in (["tossed"] if skip_statuses is None else skip_statuses)]
    keep = ~F.lower(text_or_blank(status)).isin(skip) & ~is_child if skip else ~is_child
    if only_url is not None:
        keep = keep & (url == only_url)
    if folder:
        keep = keep & F.startswith(rel_path, F.lit(folder.strip("/\\")))
    if include:
        hit = F.lit(False)
        for prefix in include:
            hit = hit | F.startswith(rel_path, F.lit(prefix.strip("/\\")))
        keep = keep & hit
    return keep


def ordered_limit(cards: DataFrame, limit: int | None) -> DataFrame:
    ordered = cards.orderBy("path")
    return ordered if limit is None else ordered.limit(max(0, limit))


def pending_analysis(cards: DataFrame, latest: DataFrame, version: str, reprocess: bool = False) -> DataFrame:
    """Adds ``skip``: the latest state is final and was produced by this prompt version."""
    state = latest.select("url", F.col("status").alias("state_status"), F.col("prompt_version").alias("state_version"))
    done = (F.col("state_version") == version) & F.col("state_status").isin(C.TERMINAL_ANALYSIS)
    skip = F.lit(False) if reprocess else F.coalesce(done, F.lit(False))
    return cards.join(state, "url", "left").withColumn("skip", skip)


def needs_enrichment(folder: Column, name: Column, confidence: Column) -> Column:
    """High-value and held cards that were never scored (or only got the zero fallback)."""
    roots = [C.TECH, C.PROJECTS, C.MOVIES, C.MANUAL_REVIEW_FOLDER]
    inside = F.lit(False)
    for root in roots:
        inside = inside | in_folder(folder, root)
    scored = confidence.isNotNull() & ~confidence.cast("string").isin("0", "0.0")
    return inside & ~_ends_with_any(name, ["Hub.md", "Kanban.md"]) & ~scored


def is_queued(folder: Column, name: Column, status: Column, stage: Column) -> Column:
    """Waiting for triage. A final status ends it even inside the holding folder."""
    status, stage = F.lower(strip(text_or_blank(status))), F.lower(strip(text_or_blank(stage)))
    return (
        F.when(F.startswith(name, F.lit(".")) | is_board(name), False)
        .when(status.isin(C.HUMAN_STATUSES), False)
        .when(in_folder(folder, C.MANUAL_REVIEW_FOLDER), True)
        .otherwise(status.isin("inbox", "manual-review") | (stage == "manual-review"))
    )


def triage_rank(folder: Column, status: Column, stage: Column) -> Column:
    status, stage = F.lower(strip(text_or_blank(status))), F.lower(strip(text_or_blank(stage)))
    return (
        F.when(in_folder(folder, C.MANUAL_REVIEW_FOLDER), 0)
        .when((status == "manual-review") | (stage == "manual-review"), 1)
        .otherwise(2)
    )


def triage_queue(cards: DataFrame) -> DataFrame:
    """Held cards first, then other manual-review cards, then the inbox."""
    queued = cards.filter(is_queued(F.col("folder"), F.col("name"), F.col("status"), F.col("stage")))
    ranked = queued.withColumn("rank", triage_rank(F.col("folder"), F.col("status"), F.col("stage")))
    return ranked.orderBy("rank", F.lower("path"))


def is_travel_card(name: Column) -> Column:
    return F.endswith(name, F.lit(".md")) & ~F.startswith(name, F.lit(".")) & ~is_board(name)


def counts_for_weight(name: Column) -> Column:
    """Weight counting excludes names that merely contain these words."""
    return ~F.contains(name, F.lit("Hub")) & ~F.contains(name, F.lit("Map"))


# --- names --------------------------------------------------------------------------


# A stem that already ends in a number, one number, and all those at its end.
_NUMBERED = r"(?s)^(.*) \(([1-9]\d*)\)\z"
_SUFFIX = r" \([1-9]\d*\)"
_TAIL = r"((?: \([1-9]\d*\))*)\z"


def _literals(new: DataFrame, existing: DataFrame, seq: str) -> DataFrame:
    """Names that are another stem with a number: ``folder, stem, x, child, had, before``.

    ``child`` is ``stem (x)``, an existing name (``had``) or a title of its own; ``before`` counts the rows of ``stem`` that arrive
    ahead of its first row.
    """
    keys = ["folder", "stem"]
    names = new.groupBy(*keys).agg(F.min(seq).cast("bigint").alias("at")).join(
        existing.select(*keys).distinct().withColumn("had", F.lit(True)), keys, "full")
    links = names.filter(F.rlike("stem", F.lit(_NUMBERED))).select(
        "folder", F.regexp_extract("stem", _NUMBERED, 1).alias("stem"),
        # A number beyond 64 bits is never reached by counting.
        F.regexp_extract("stem", _NUMBERED, 2).try_cast("bigint").alias("x"),
        F.col("stem").alias("child"), F.coalesce("had", F.lit(False)).alias("had"), F.when(F.col("had").isNull(), F.col("at")).alias("at"),
    ).filter("x >= 2")
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("x", "bigint"), ("child", "string"), ("had", "boolean"))]
    rows = new.join(links.select(*keys).distinct(), keys, "left_semi").select(*keys, *blank, F.col(seq).cast("bigint").alias("at"), F.lit(1).alias("w"))
    waiting = links.filter("not had").select(*keys, "x", "child", "had", "at", F.lit(0).alias("w"))
    counted = running_sums(union_all(rows, waiting), keys, "at", {"before": F.col("w")}).filter("child is not null")
    columns = [*keys, "x", "child", "had"]
    return union_all(counted.select(*columns, F.col("before").cast("bigint").alias("before")),
                     links.filter("had").select(*columns, F.lit(0).cast("bigint").alias("before")))


def _settled(literals: DataFrame, store) -> DataFrame:
    """``literals`` with ``lost0, lost1``: whether ``child`` finds its name taken by the numbering of ``stem``.

    Of two answers the first holds while the stem's own name is free to it, the second if that is taken. Below ``x`` the numbering skips the
    kept names, ``s`` of them, and has used ``before`` of the other ``x - 1 - s``; so a name is kept if ``before <= x - 1 - s``. How many
    literals lie below is known, so most are settled at once; the rest of a stem, usually none, are gone through in order.
    """
    keys = ["folder", "stem"]
    room = F.col("x") - 1 - F.col("before")
    ranked = row_numbers(literals, keys, "x", "__r").withColumns({"__room": room, "__kept": F.col("had") | (room >= F.col("__r"))})
    ranked = store(ranked.withColumn("__open", ~F.col("__kept") & (F.col("__room") >= 0)), "literals")
    lost = lambda df: df.withColumns({"lost0": ~F.col("__kept"), "lost1": ~F.col("__kept")})
    tidy = lambda df: df.select(*keys, "x", "child", "had", "lost0", "lost1")
    if ranked.filter("__open").isEmpty():
        return tidy(lost(ranked))
    opened = ranked.filter("__open").select(*keys).distinct()
    below = running_sums(ranked.join(opened, keys, "left_semi"), keys, "x", {"__sure": F.col("__kept").cast("bigint")})

    def in_order(pdf):
        import numpy as np

        pdf = pdf.sort_values("x", ignore_index=True)
        free = (pdf["room"] - pdf["sure"]).tolist()
        for name, kept in (("lost0", 0), ("lost1", 1)):
            out = np.zeros(len(free), dtype=bool)
            for i, most in enumerate(free):
                out[i] = most < kept
                kept += most >= kept
            pdf[name] = out
        return pdf[["folder", "stem", "x", "lost0", "lost1"]]

    narrow = below.filter("__open").select(*keys, "x", F.col("__room").alias("room"), F.col("__sure").alias("sure"))
    walked = narrow.groupBy(*keys).applyInPandas(in_order, "folder string, stem string, x bigint, lost0 boolean, lost1 boolean")
    return store(union_all(tidy(lost(ranked.filter("not __open"))), tidy(ranked.filter("__open").join(walked, [*keys, "x"]))), "settled")


def _occupied(new: DataFrame, existing: DataFrame, seq: str, store) -> DataFrame:
    """``folder, stem, x``: indexes the numbering of a new stem skips. The name itself is 1, ``stem (n)`` is n.

    Whether a name is free to its stem depends on the stem it is a number of, that one's on the next, down to the bare title: each answers
    for both cases, so a stem's answer is a fold over its own few prefixes.
    """
    keys = ["folder", "stem"]
    settled = _settled(_literals(new, existing, seq), store)
    answers = union_all(
        settled.select("folder", F.col("child").alias("name"), (F.col("had") | F.col("lost0")).alias("g0"), (F.col("had") | F.col("lost1")).alias("g1")),
        existing.select("folder", F.col("stem").alias("name"), F.lit(True).alias("g0"), F.lit(True).alias("g1")),
    ).groupBy("folder", "name").agg(F.max("g0").alias("g0"), F.max("g1").alias("g1"))
    tail = F.regexp_extract("stem", _TAIL, 1)
    root = F.substring(F.col("stem"), F.lit(1), F.length("stem") - F.length(tail))
    parts = F.regexp_extract_all(tail, F.lit(_SUFFIX), F.lit(0))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(root, F.array_join(F.slice(parts, F.lit(1), i), "")))
    steps = new.select(*keys).distinct().select(*keys, F.posexplode(prefixes).alias("i", "name"))
    path = F.array_sort(F.collect_list(F.struct("i", "g0", "g1")))
    entered = steps.join(answers, ["folder", "name"]).groupBy(*keys).agg(path.alias("path"), F.max("i").alias("at"))
    # A prefix without an answer is free, and so is what follows it unless that answers for both cases.
    fold = F.aggregate("path", F.struct(F.lit(-1).alias("i"), F.lit(False).alias("b")), lambda a, p: F.struct(
        p["i"].alias("i"), F.when(a["b"] & (p["i"] == a["i"] + 1), p["g1"]).otherwise(p["g0"]).alias("b")), lambda a: a)
    own = entered.withColumn("end", fold).filter(F.col("end")["b"]).join(
        new.select(*keys).distinct().select(*keys, F.size(parts).alias("deep")), keys).filter(F.col("at") == F.col("deep")).select(*keys)
    taken = settled.join(own.withColumn("__own", F.lit(True)), keys, "left")
    kept = F.when(F.col("__own"), ~F.col("lost1")).otherwise(~F.col("lost0"))
    return union_all(own.withColumn("x", F.lit(1).cast("bigint")), taken.filter(kept).select(*keys, "x"))


def _numbered_names(new: DataFrame, taken: DataFrame, seq: str) -> DataFrame:
    """Give the k-th new row of a stem the k-th free index.

    With occupied indexes x_1 < x_2 < ..., row k lands on k plus the number of x_j with
    x_j - j < k. Those offsets are merged into the ordered rows and counted by a running sum.
    """
    keys = ["folder", "stem"]
    ranked = row_numbers(new, keys, seq, "__k")
    used = taken.join(new.select(*keys).distinct(), keys, "left_semi").distinct()
    offsets = (
        row_numbers(used, keys, "x", "__j")
        .groupBy(*keys, (F.col("x") - F.col("__j")).alias("thr")).agg(F.count(F.lit(1)).alias("w"))
        .select(*keys, (F.col("thr") * 2 + 1).alias("at"), "w", F.lit(None).cast("bigint").alias(seq))
    )
    rows = ranked.select(*keys, (F.col("__k") * 2).alias("at"), F.lit(0).cast("bigint").alias("w"), F.col(seq).cast("bigint").alias(seq))
    merged = running_sums(union_all(rows, offsets), keys, "at", {"shift": F.col("w")}, dense=True)
    index = F.expr("at div 2") + F.col("shift")
    named = F.when(index == 1, F.col("stem")).otherwise(F.concat("stem", F.lit(" ("), index.cast("string"), F.lit(")")))
    return merged.filter(F.col(seq).isNotNull()).select(*keys, seq, index.alias("x"), named.alias("final_stem"))


def unique_names(new: DataFrame, existing: DataFrame, seq: str = "seq", store=None) -> DataFrame:
    """Collision-free file stems in arrival order: ``stem``, ``stem (2)``, ``stem (3)`` ...

    ``new`` and ``existing`` have ``folder, stem``. A literal title such as ``a (2)`` can meet a numbered ``a``; the earlier of
    them keeps the name, as in naming one at a time. Which of them that is follows from counts of rows, so all names come from one
    pass, however the titles are nested.
    """
    from linkshelf.session import materialize

    return _numbered_names(new, _occupied(new, existing, seq, store or materialize), seq)


# --- aggregates ----------------------------------------------------------------------


def reweighted(cards: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """Travel cards whose weight or colour differs from the current place count.

    Hub and map notes (``name``) are no cards: they neither count nor change. A card without weight has weight 0. With a
    ``gazetteer(place, lat, lon)``, one row a place, changed cards that lack ``lat`` get their place's coordinates.
    """
    named = cards.withColumn("place", strip(text_or_blank(F.col("location_name")))).filter(F.col("place") != "")
    if "name" in cards.columns:
        named = named.filter(~F.contains("name", F.lit("Hub")) & ~F.contains("name", F.lit("Map")))
    counts = named.groupBy("place").agg(F.count(F.lit(1)).alias("new_weight"))
    joined = named.join(counts, "place").withColumn("new_color", weight_color(F.col("new_weight")))
    same = (F.coalesce("weight", F.lit(0)) == F.col("new_weight")) & F.col("color").eqNullSafe(F.col("new_color"))
    changed = joined.filter(~same)
    if gazetteer is None:
        return changed.drop("place")
    places = gazetteer.filter(coordinates_ok(F.col("lat"), F.col("lon"))).select(
        F.lower(squeeze(F.col("place"))).alias("__place"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    filled = changed.withColumn("__key", F.lower(squeeze(F.col("place")))).join(places, F.col("__key") == F.col("__place"), "left")
    lacks = F.col("lat").isNull()
    return filled.withColumns({
        "lat": F.when(lacks, F.col("__lat")).otherwise(F.col("lat")), "lon": F.when(lacks, F.col("__lon")).otherwise(F.col("lon")),
    }).drop("place", "__key", "__place", "__lat", "__lon")


def board_entries(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One entry per title in its column, the latest arrival on top. ``position`` counts from 1."""
    added = rows.groupBy("column", "title").agg(F.min(seq).alias("added_seq"))
    newest = row_numbers(added.withColumn("__desc", -F.col("added_seq")), ["column"], "__desc", "position")
    return newest.drop("__desc")


def merged_titles(clips: DataFrame, seq: str = "seq", notes: DataFrame | None = None) -> DataFrame:
    """Clips of one title: the first keeps the card, the others are merged into it.

    ``notes(title)`` are the cards that exist before the run; titles among them get no new card, all clips are merged.
    """
    first = clips.groupBy("title").agg(F.min(seq).alias("__first"), F.count(F.lit(1)).alias("clips"))
    if notes is None:
        first = first.withColumn("__old", F.lit(False))
    else:
        first = first.join(notes.select("title").distinct().withColumn("__hit", F.lit(True)), "title", "left")
        first = first.withColumn("__old", F.coalesce("__hit", F.lit(False))).drop("__hit")
    return clips.join(first, "title").withColumn("merged", F.col("__old") | (F.col(seq) != F.col("__first"))).drop("__first", "__old")


def merge_events(merged: DataFrame) -> DataFrame:
    """Ledger events of a run over movie clips: ``merged`` for a clip that joined a card, ``carded`` for one that made it."""
    return merged.select("url", F.when(F.col("merged"), "merged").otherwise("carded").alias("event"))


def missing_hubs(folders: DataFrame, notes: DataFrame) -> DataFrame:
    """Folders without their hub note. Model-owned folders, the inbox and dot folders need none."""
    wanted = folders.filter(
        ~F.col("folder").isin([*C.MODEL_OWNED_FOLDERS, C.DEFAULT_FOLDER]) & ~F.startswith("folder", F.lit("."))
    ).withColumn("name", F.concat("folder", F.lit(" Hub.md")))
    return wanted.join(notes.select("folder", "name"), ["folder", "name"], "left_anti").select("folder", F.col("name").alias("hub"))


def category_of_folder(taxonomy: DataFrame) -> DataFrame:
    """Folder back to category: an identical name or the only match wins, else the folder name."""
    rolled = taxonomy.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n"), F.max("category").alias("only"), F.max(F.col("category") == F.col("folder")).alias("same")
    )
    return rolled.select("folder", F.when(F.col("same"), F.col("folder")).when(F.col("n") == 1, F.col("only")).otherwise(F.col("folder")).alias("category"))


def resolved_names(typed: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """Case-insensitive name resolution: exact first, then a single match, else as typed."""
    keys = existing.groupBy(F.lower(F.col("existing")).alias("__low")).agg(
        F.count(F.lit(1)).alias("__n"), F.max("existing").alias("__only")
    )
    exact = existing.select(F.col("existing").alias(name), F.lit(True).alias("__exact")).distinct()
    joined = typed.withColumn("__low", F.lower(name)).join(keys, "__low", "left").join(exact, name, "left")
    pick = F.when(F.col("__exact"), F.col(name)).when(F.col("__n") == 1, F.col("__only")).otherwise(F.col(name))
    return joined.withColumn("resolved", pick).drop("__low", "__n", "__only", "__exact")


# --- triage decisions ------------------------------------------------------------------


def triage_effects(cards: DataFrame, decisions: DataFrame, taxonomy: DataFrame, folders: DataFrame,
                   projects: DataFrame) -> DataFrame:
    """What each decision does to its card.

    ``decisions`` has ``path, action, arg`` with action k, m, p, t, d or s. ``folders`` and
    ``projects`` list existing directory names (column ``existing``). Adds ``outcome`` and the
    ``new_*`` columns; a rejected name leaves the card as it is.
    """
    rows = cards.join(decisions, "path")
    typed = (
        F.when(F.col("action") == "m", folder_segment(F.col("arg")))
        .when(F.col("action") == "p", project_name(F.col("arg")))
        .when(
            (F.col("action") == "k") & in_folder(F.col("folder"), C.MANUAL_REVIEW_FOLDER),
            folder_for(F.col("category")),
        )
    )
    rows = rows.withColumn("typed", typed)
    area = lambda df, where: df.select(F.lit(where).alias("where"), "existing")
    known = union_all(area(folders, "folder"), area(projects, "project"))
    keyed = rows.withColumn("where", F.when(F.col("action") == "p", "project").otherwise("folder"))
    matches = known.groupBy("where", F.lower("existing").alias("low")).agg(
        F.collect_set("existing").alias("names")
    )
    # A name has a handful of case variants, so the set per lower-case name is small.
    joined = keyed.withColumn("low", F.lower("typed")).join(matches, ["where", "low"], "left")
    target = F.when(
        F.array_contains("names", F.col("typed")) | (F.coalesce(F.size("names"), F.lit(0)) != 1), F.col("typed")
    ).otherwise(F.get("names", F.lit(0)))
    joined = joined.withColumn("target", target).drop("where", "low", "names", "typed")
    back = category_of_folder(taxonomy).select(F.col("folder").alias("target"), F.col("category").alias("target_category"))
    joined = joined.join(F.broadcast(back), "target", "left")  # one row per taxonomy folder

    rewritable = F.col("fm_state") == "ok"
    action = F.col("action")
    outcome = (
        F.when(action == "d", "deleted")
        .when(action == "s", "skipped")
        .when(~rewritable, "rejected")
        .when(action == "k", "kept")
        .when((action == "m") & F.col("target").isNotNull(), "moved")
        .when((action == "p") & F.col("target").isNotNull(), "promoted")
        .when(action == "t", "tossed")
        .otherwise("rejected")
    )
    joined = joined.withColumn("outcome", outcome)
    changes = F.col("outcome").isin("kept", "moved", "promoted", "tossed")
    held = F.lower(strip(text_or_blank(F.col("stage")))) == "manual-review"
    moved_to = F.coalesce("target_category", "target")
    return joined.withColumns({
        "new_status": F.when(F.col("outcome").isin("kept", "promoted", "tossed"), F.col("outcome")).otherwise(F.col("status")),
        "new_stage": F.when(changes & held, F.lit(None).cast("string")).otherwise(F.col("stage")),
        "new_category": F.when(F.col("outcome") == "moved", moved_to).otherwise(F.col("category")),
        "new_tags": F.when(F.col("outcome") == "moved", replace_category_tag(F.col("tags"), moved_to)).otherwise(F.col("tags")),
        "new_folder": F.when(F.col("outcome") == "promoted", F.concat(F.lit(C.PROJECTS_ROOT + "/"), "target"))
        .when(F.col("outcome").isin("moved", "kept") & F.col("target").isNotNull(), F.concat(F.lit(C.LIBRARY_ROOT + "/"), "target"))
        .when(F.col("outcome") != "deleted", F.concat(F.lit(C.LIBRARY_ROOT + "/"), "folder")),
    }).drop("target", "target_category")


def deletion_events(effects: DataFrame) -> DataFrame:
    """Ledger rows to append before deleted cards are removed."""
    gone = effects.filter((F.col("outcome") == "deleted") & (text_or_blank(F.col("url")) != ""))
    return gone.select("url", F.lit("tossed").alias("event"), F.lit("model-d").alias("source"))


# --- folder reads ("hubs") ----------------------------------------------------------------


def folder_list(cards: DataFrame, folder: str) -> DataFrame:
    """Live cards of a folder, newest first."""
    live = cards.filter(in_folder(F.col("folder"), folder) & is_not(F.col("status"), "tossed") & ~is_board(F.col("name")))
    return live.orderBy(F.desc_nulls_last("ctime"))


def recent_music(cards: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Unarchived music of the last ``days`` days."""
    since = F.lit(as_of).cast("date") - F.expr(f"INTERVAL {int(days)} DAYS")
    live = cards.filter(
        in_folder(F.col("folder"), "Music") & is_not(F.col("status"), "tossed") & is_not(F.col("stage"), "archived")
        & (F.col("ctime") >= since.cast("timestamp")) & ~is_board(F.col("name"))
    )
    return live.orderBy(F.desc_nulls_last("ctime"))


def live_stream(cards: DataFrame, folder: str) -> DataFrame:
    """Folder stream that also hides manual review, by status and by stage."""
    live = cards.filter(
        in_folder(F.col("folder"), folder) & is_not(F.col("status"), "tossed") & is_not(F.col("status"), "manual-review")
        & is_not(F.col("stage"), "manual-review") & ~is_board(F.col("name"))
    )
    return live.orderBy(F.desc_nulls_last("ctime"))


def manual_review_list(cards: DataFrame, folder: str) -> DataFrame:
    held = (F.col("status") == "manual-review") | (F.col("stage") == "manual-review")
    return cards.filter(in_folder(F.col("folder"), folder) & held).orderBy(F.desc_nulls_last("ctime"))


def travel_hotspots(cards: DataFrame) -> DataFrame:
    """Travel cards by reference count, then newest."""
    live = cards.filter(in_folder(F.col("folder"), "Travel") & is_not(F.col("status"), "tossed") & ~is_board(F.col("name")))
    return live.orderBy(F.desc_nulls_last("weight"), F.desc_nulls_last("ctime"))


def folder_table(cards: DataFrame, folder: str) -> DataFrame:
    """Cards that carry a URL, by status, then newest."""
    live = cards.filter(
        in_folder(F.col("folder"), folder) & (text_or_blank(F.col("url")) != "") & is_not(F.col("status"), "tossed")
    )
    return live.orderBy(F.asc_nulls_first("status"), F.desc_nulls_last("ctime"))


def inbox_list(cards: DataFrame, folder: str) -> DataFrame:
    return cards.filter(in_folder(F.col("folder"), folder) & (F.col("status") == "inbox"))


def legacy_ready_list(cards: DataFrame, folder: str) -> DataFrame:
    """The older list that kept pipeline state in ``status``."""
    ready = cards.filter(in_folder(F.col("folder"), folder) & (F.col("status") == "ready") & ~is_board(F.col("name")))
    return ready.orderBy(F.desc_nulls_last("ctime"))


def legacy_recent_music(cards: DataFrame, as_of, days: int = 7) -> DataFrame:
    since = F.lit(as_of).cast("date") - F.expr(f"INTERVAL {int(days)} DAYS")
    live = cards.filter(
        in_folder(F.col("folder"), "Music") & is_not(F.col("status"), "archived") & is_not(F.col("status"), "tossed")
        & (F.col("ctime") >= since.cast("timestamp")) & ~is_board(F.col("name"))
    )
    return live.orderBy(F.desc_nulls_last("ctime"))


def map_point(location: Column) -> Column:
    """``STRUCT<lat, lon>`` from ``[lat, lng]`` or ``"lat,lng"`` text; NULL when unusable."""
    pattern = r"^\s*\[?\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]?\s*$"
    lat = F.regexp_extract(text_or_blank(location), pattern, 1).try_cast("double")
    lon = F.regexp_extract(text_or_blank(location), pattern, 2).try_cast("double")
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def map_points(cards: DataFrame) -> DataFrame:
    """Travel cards with a usable location."""
    pinned = cards.filter(in_folder(F.col("folder"), "Travel")).withColumn("point", map_point(F.col("location")))
    return pinned.filter(F.col("point").isNotNull()).withColumn("lat", F.col("point.lat")).withColumn("lon", F.col("point.lon")).drop("point")


def with_folders(rows: DataFrame, taxonomy: DataFrame, category: str = "cat") -> DataFrame:
    """``rows`` with the folder of their category, the default one where the taxonomy has none."""
    dim = taxonomy.select(F.col("category").alias(category), "folder")  # fixed size: one row per category
    return rows.join(F.broadcast(dim), category, "left").withColumn("folder", F.coalesce("folder", F.lit(C.DEFAULT_FOLDER)))


def first_names(items: DataFrame, key: str, name: str, cap: int) -> DataFrame:
    """The first ``cap`` distinct names of each key as ``names``. Ranked before the list is built, so no list is longer."""
    order = Window.partitionBy(key).orderBy(name)
    ranked = items.select(key, name).distinct().withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= cap)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("names"))
