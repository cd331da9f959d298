"""SQL spellings of the column functions, used to state each query a second time for checking."""

from __future__ import annotations

import re

from linkshelf import constants as C


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def list_of(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def case_map(x: str, values: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items())
    return f"(CASE {x} {arms} ELSE {default} END)"


def strip(x: str) -> str:
    return f"trim({x}, {lit(C.SPACE_CHARS)})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {lit(C.SPACE_CHARS)})"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(C.SPACE_CLASS + '+')}, ' ', 'g'))"


def first_of(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs[:-1]) + f", {xs[-1]})"


def contains_any(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


_URL = r"^([hH][tT][tT][pP][sS]?)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def valid_url(u: str) -> str:
    return f"regexp_matches({u}, '^(?i:https?)://[^/?#]+')"


def tracking(name: str) -> str:
    return f"(lower({name}) IN {in_list(C.TRACKING_PARAMS)} OR starts_with(lower({name}), {lit(C.TRACKING_PREFIX)}))"


def form_decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def form_encode(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def canonical(u: str) -> str:
    raw = strip(f"coalesce({u}, '')")
    part = lambda n: f"regexp_extract({raw}, {lit(_URL)}, {n})"
    name, value = "split_part(s, '=', 1)", "substr(s, length(split_part(s, '=', 1)) + 2)"
    kept = f"list_filter(string_split(substr({part(4)}, 2), '&'), lambda s: s <> '' AND NOT {tracking(form_decode(name))})"
    pairs = f"list_transform({kept}, lambda s: {form_encode(form_decode(name))} || '=' || {form_encode(form_decode(value))})"
    query = f"array_to_string({pairs}, '&')"
    frag = f"CASE WHEN length({part(5)}) > 1 THEN {part(5)} ELSE '' END"
    return (
        f"(CASE WHEN regexp_matches({raw}, {lit(_URL)}) THEN lower({part(1)}) || '://' || lower({part(2)}) || "
        f"rtrim({part(3)}, '/') || (CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END) || {frag} "
        f"ELSE rtrim({raw}, '/') END)"
    )


def canonical_category(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    return case_map(s, C.CATEGORY_ALIASES, s)


def folder(x: str) -> str:
    return case_map(canonical_category(x), C.CATEGORY_FOLDERS, lit(C.DEFAULT_FOLDER))


def slug(x: str) -> str:
    return f"replace({squeeze(f'''translate(replace({x}, '&', ' and '), '/-', '  ')''')}, ' ', '-')"


def category_tag(x: str) -> str:
    return f"('category/' || {first_of(slug(f'lower({canonical_category(x)})'), lit('uncategorized'))})"


def reserved(x: str) -> str:
    return f"(upper(split_part({x}, '.', 1)) IN {in_list(C.RESERVED_NAMES)})"


def safe_filename(x: str, limit: int = 60, fallback: str = "Saved Video") -> str:
    legal = f"regexp_replace(coalesce({x}, ''), {lit(C.ILLEGAL_NAME_CHARS)}, '', 'g')"
    cut = f"rtrim({strip(f'left({squeeze(legal)}, {limit})')}, '. ')"
    return f"(CASE WHEN {cut} = '' THEN {lit(fallback)} WHEN {reserved(cut)} THEN '_' || {cut} ELSE {cut} END)"


def list_claim(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), {lit('(?i)' + C.LIST_CLAIM_PATTERN)})"


def words(x: str) -> str:
    return (
        f"(CASE WHEN {strip(f'''coalesce({x}, '')''')} = '' THEN 0 ELSE "
        f"len(string_split({squeeze(x)}, ' ')) END)::BIGINT"
    )


def failure(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    return (
        f"(CASE WHEN {contains_any(low, C.PERMANENT_MARKERS)} THEN 'permanent' "
        f"WHEN {contains_any(low, C.TRANSIENT_MARKERS)} THEN 'transient' END)"
    )


def quoted(x: str) -> str:
    return f"to_json(coalesce({x}, ''))::VARCHAR"


def weight_color(x: str) -> str:
    arms = " ".join(f"WHEN {x} >= {m} THEN {lit(c)}" for m, c in C.WEIGHT_COLORS)
    return f"(CASE {arms} ELSE {lit(C.WEIGHT_ZERO_COLOR)} END)"


def stage_for(category: str, usable: str = "TRUE") -> str:
    c = canonical_category(category)
    return (
        f"(CASE WHEN NOT {usable} THEN 'manual-review' WHEN {c} IN {in_list([C.FITNESS, C.RECIPES])} THEN 'ready' "
        f"WHEN {c} = {lit(C.MOVIES)} THEN 'to-watch' END)"
    )


def place_query(place: str, country: str) -> str:
    p, c = squeeze(f"coalesce({place}, '')"), squeeze(f"coalesce({country}, '')")
    return (
        f"(CASE WHEN {p} = '' THEN NULL WHEN {c} <> '' AND NOT contains(lower({p}), lower({c})) "
        f"THEN {p} || ', ' || {c} ELSE {p} END)"
    )


def in_folder(folder_col: str, root: str) -> str:
    return f"({folder_col} = {lit(root)} OR starts_with({folder_col}, {lit(root + '/')}))"


def is_board(name: str) -> str:
    return "(" + " OR ".join(f"ends_with({name}, {lit(s)})" for s in C.BOARD_SUFFIXES) + ")"


def clock(sec: str) -> str:
    return f"(({sec})::BIGINT // 60)::VARCHAR || ':' || lpad((({sec})::BIGINT % 60)::VARCHAR, 2, '0')"


# --- derived tables -----------------------------------------------------------------------

_T = list_of(C.CATEGORIES + ["Unknown A", "Unknown B"])
_KINDS = list_of(C.ITEM_KINDS)
_VIDEO = "'https://v.example.com/' || source || '/' || doc_id"

DERIVED = {
    "captures": """
        SELECT p.page_id AS seq, CASE p.page_id % 5
            WHEN 0 THEN b.base
            WHEN 1 THEN b.base || '?utm_source=x&IGSH=y'
            WHEN 2 THEN '  ' || upper(regexp_extract(b.base, '^[a-z]+://[^/]*', 0)) || regexp_replace(b.base, '^[a-z]+://[^/]*', '')
            WHEN 3 THEN b.base || '/?a=1&_t=z'
            ELSE 'not a url ' || p.page_id || '/' END AS line
        FROM pages p JOIN (SELECT page_id, rtrim(regexp_extract(url, '^[^?#]*', 0), '/') AS base FROM pages) b
          ON b.page_id = p.page_id - p.page_id % 5""",
    "capture_urls": f"""
        SELECT seq, trim(line) AS line, {valid_url('trim(line)')} AS valid,
               CASE WHEN {valid_url('trim(line)')} THEN {canonical('line')} END AS url FROM captures""",
    "known": "SELECT DISTINCT url FROM capture_urls WHERE seq % 15 = 0 AND valid",
    "video_metadata": f"""
        SELECT doc_id, {_VIDEO} AS url,
            CASE doc_id % 7 WHEN 0 THEN 'Top 10 places to see' WHEN 1 THEN 'my favourite songs' WHEN 2 THEN '' ELSE text END AS title,
            CASE WHEN doc_id % 9 = 0 THEN '#' || source ELSE text || ' #' || lang || ' #' || source || ' #' || lang END AS description,
            CASE WHEN doc_id % 11 <> 0 THEN source END AS creator, [lang, source, ''] AS tags,
            ((doc_id * 7) % 240)::DOUBLE AS duration, doc_id % 13 = 0 AS is_carousel, text, lang, source
        FROM documents""",
    "cards": f"""
        SELECT d.doc_id, {_VIDEO.replace('source', 'd.source').replace('doc_id', 'd.doc_id')} AS url, c.category, f.folder,
            n.name, '3 - Resources/' || f.folder || '/' || n.name AS path,
            [NULL, 'inbox', 'kept', 'tossed', 'promoted', 'manual-review', 'ready', 'To Watch', 'archived', NULL][d.doc_id % 9 + 2] AS status,
            [NULL, NULL, 'ready', 'to-watch', 'manual-review', 'archived'][d.doc_id % 5 + 2] AS stage,
            TIMESTAMP '2024-01-31 00:00:00' - to_hours(d.doc_id) AS ctime,
            ['old-library', 'category/recipes-&-food', d.lang] AS tags,
            CASE d.doc_id % 3 WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE END AS confidence,
            d.source AS creator, d.text AS summary, d.text, l.quality
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id,
        LATERAL (SELECT CASE WHEN d.doc_id % 28 = 0 THEN 'Music' ELSE {_T}[d.doc_id % 14 + 1] END AS category) c,
        LATERAL (SELECT CASE WHEN d.doc_id % 17 = 0 THEN 'Inbox/Manual Review' ELSE {folder('c.category')} END AS folder) f,
        LATERAL (SELECT d.doc_id || CASE d.doc_id % 50 WHEN 7 THEN ' Hub.md' WHEN 8 THEN ' Map notes.md' ELSE '.md' END AS name) n""",
    "scores": f"""
        SELECT doc_id, 0 AS pos, {_T}[(doc_id * 5) % 16 + 1] AS cat, ((doc_id * 37) % 100) / 100.0::DOUBLE AS confidence,
               ((doc_id * 53) % 100) / 100.0::DOUBLE AS needs_visuals FROM documents WHERE doc_id % 10 <> 3
        UNION ALL
        SELECT doc_id, 1, {_T}[(doc_id * 3) % 16 + 1], ((doc_id * 41) % 100) / 100.0::DOUBLE, ((doc_id * 59) % 100) / 100.0::DOUBLE
        FROM documents WHERE doc_id % 10 = 4""",
    "best_scores": "SELECT doc_id, max_by(cat, pos) AS cat, max_by(confidence, pos) AS confidence, max_by(needs_visuals, pos) AS needs_visuals FROM scores GROUP BY doc_id",
    "ledger": f"""
        SELECT e.event_id AS seq, {_VIDEO.replace('source', 'd.source').replace('doc_id', 'd.doc_id')} AS url,
               ['carded', 'tossed', 'merged'][e.event_id % 3 + 1] AS event
        FROM events e JOIN documents d ON d.doc_id = e.user_id""",
    "analysis_state": f"""
        SELECT e.event_id AS seq, {_VIDEO.replace('source', 'd.source').replace('doc_id', 'd.doc_id')} AS url,
               ['done', 'failed-retryable', 'unavailable', 'needs-review', 'manual-review'][e.event_id % 5 + 1] AS status,
               CASE e.event_id % 2 WHEN 0 THEN '2' ELSE '3' END AS prompt_version, e.event_id % 4 AS attempts, e.ts
        FROM events e JOIN documents d ON d.doc_id = e.user_id""",
    "latest_state": """
        SELECT url, max_by(status, seq) AS status, max_by(prompt_version, seq) AS prompt_version, max_by(attempts, seq) AS attempts
        FROM analysis_state GROUP BY url""",
    "request_log": """
        SELECT event_id AS seq, TIMESTAMP '2024-01-01 07:30:00' + to_seconds(event_id * 5) AS ts, 'K' || user_id % 4 AS key,
               CASE WHEN event_type IN ('click', 'view') THEN 'llm' ELSE 'classifier' END AS provider,
               floor(value * 100)::BIGINT AS in_tokens, floor(value * 10)::BIGINT AS out_tokens
        FROM events""",
    "cues": """
        SELECT conv_id AS video, turn AS pos, turn * 4.0::DOUBLE AS start_s,
               'line ' || (turn - CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END) AS line FROM conversations""",
    "segments": """
        SELECT event_id AS seq, user_id AS clip, (event_id % 600)::DOUBLE AS start_s, event_id % 600 + value / 100 AS end_s,
               (event_id % 10) / 10.0::DOUBLE AS no_speech, -(event_id % 4) * 0.6::DOUBLE AS logprob, event_type AS text, 600.0::DOUBLE AS duration
        FROM events""",
    "items": f"""
        SELECT l_orderkey AS video, l_linenumber::BIGINT AS position, {_KINDS}[l_partkey % 12 + 1] AS kind, 'item ' || l_partkey AS name
        FROM lineitem""",
    "travel_cards": f"""
        SELECT s_suppkey AS id, n_name AS location_name, s_suppkey % 8 AS weight,
               CASE WHEN s_suppkey % 2 = 1 THEN '#000000' ELSE {weight_color('s_suppkey % 8')} END AS color,
               'card ' || s_suppkey || CASE s_suppkey % 9 WHEN 0 THEN ' Hub.md' WHEN 1 THEN ' Map.md' ELSE '.md' END AS name,
               CASE WHEN s_suppkey % 3 = 0 THEN 1.5::DOUBLE END AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 2.5::DOUBLE END AS lon
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "gazetteer": """
        SELECT n_name AS place, CASE WHEN n_nationkey = 7 THEN 200.0::DOUBLE ELSE n_nationkey * 5.0::DOUBLE - 60 END AS lat,
               n_nationkey * 10.0::DOUBLE - 120 AS lon FROM nation WHERE n_nationkey % 4 <> 0""",
    "fetch_log": f"""
        SELECT doc_id, {_VIDEO} AS url, CASE doc_id % 5 WHEN 0 THEN 'HTTP Error 429' WHEN 1 THEN 'Private video ... HTTP Error 429'
               WHEN 2 THEN 'timed out' WHEN 3 THEN '404: Not Found' ELSE text END AS stderr FROM documents""",
    "redirects": "SELECT url AS short, replace(url, '//m.', '//') || '?x=1' AS target FROM pages WHERE contains(url, '//m.')",
    "movies": "SELECT p_partkey AS seq, p_type AS title, 'https://v.example.com/p/' || p_partkey AS url FROM part",
    "taxonomy": "SELECT unnest([" + ", ".join(
        f"{{'ord': {i}, 'category': {lit(c)}, 'folder': {lit(f)}, 'hint': {lit(C.CATEGORY_HINTS[c]) if c in C.CATEGORY_HINTS else 'NULL::VARCHAR'}}}"
        for i, (c, f) in enumerate(C.CATEGORY_FOLDERS.items())
    ) + "], recursive := true)",
}


def with_derived(body: str) -> str:
    """``body`` preceded by the derived tables it names, directly or through one another."""
    needed: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name, definition in DERIVED.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                queue.append(definition)
    ctes = ", ".join(f"{n} AS ({d})" for n, d in DERIVED.items() if n in needed)
    if not ctes:
        return body
    inner = body.lstrip()
    if inner[:5].upper() == "WITH ":
        recursive = inner[5:].lstrip().upper().startswith("RECURSIVE ")
        rest = inner[5:].lstrip()[10:] if recursive else inner[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}, {rest}"
    return f"WITH {ctes} {inner}"
