"""URL and key columns.

One pattern match splits a URL; a URL without a query never reaches the parameter functions,
and one whose query is plain text skips decoding and encoding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.bind import let
from linkshelf.functions.text import strip


# Scheme with host, path, query and fragment of an absolute http(s) URL.
_HTTP_URL = r"(?s)^([hH][tT][tT][pP][sS]?://[^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SEP = "\x01\x02"
# A query that form decoding and encoding would leave as it is.
_PLAIN_QUERY = r"^(?:[A-Za-z0-9_.~-]*(?:=[A-Za-z0-9_.~-]*)?(?:&|$))*$"


def _after(whole: Column, head: Column) -> Column:
    """What follows ``head`` and its one-character delimiter."""
    return F.substr(whole, F.length(head) + 2)


def _parts(url: Column) -> Column:
    """``[scheme and host, path, query, fragment]`` by one pattern match; any other size is no http URL."""
    clean = F.when(F.rlike(url, F.lit(r"[\t\r\n]")), F.translate(url, "\t\r\n", "")).otherwise(url)
    return F.split(F.regexp_replace(clean, _HTTP_URL, _SEP.join(["$1", "$2", "$3", "$4"])), _SEP)


def _balanced(host: Column) -> Column:
    return F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))


def _trimmed_path(path: Column) -> Column:
    """Path without trailing slashes; the parameters of the last segment are kept apart."""
    last = F.substring_index(path, "/", -1)
    name = F.substring_index(last, ";", 1)
    params = _after(last, name)
    bare = F.rtrim(F.concat(F.left(path, F.length(path) - F.length(last)), name), F.lit("/"))
    with_params = F.concat(F.when((bare == "") & (params != ""), "/").otherwise(bare), F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""))
    return F.when(F.contains(path, F.lit(";")), with_params).otherwise(F.rtrim(path, F.lit("/")))


def _decode(value: Column) -> Column:
    # A stray percent sign is data, so it is escaped before decoding.
    return F.try_url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(value: Column) -> Column:
    # Form encoding escapes '*' and leaves '~', the opposite of the JVM encoder.
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def is_tracking_param(name: Column) -> Column:
    """True for share and ad-click parameter names."""
    low = F.lower(name)
    return low.isin(C.TRACKING_PARAMS) | F.startswith(low, F.lit(C.TRACKING_PREFIX))


def query_params(query: Column) -> Column:
    """``ARRAY<STRUCT<name, value>>`` of decoded pairs; blank values stay, empty segments go."""
    segments = F.filter(F.split(query, "&"), lambda s: s != "")

    def pair(segment: Column) -> Column:
        name = F.substring_index(segment, "=", 1)
        return F.named_struct(F.lit("name"), _decode(name), F.lit("value"), _decode(_after(segment, name)))

    return F.transform(segments, pair)


def url_query(url: Column) -> Column:
    """Raw query string of a URL ('' when absent)."""
    return F.coalesce(F.get(_parts(strip(F.coalesce(url, F.lit("")))), F.lit(2)), F.lit(""))


def _clean_query(query: Column) -> Column:
    segments = F.filter(
        F.split(query, "&"), lambda s: (s != "") & ~is_tracking_param(F.substring_index(s, "=", 1))
    )
    plain = F.array_join(F.transform(segments, lambda s: F.when(F.contains(s, F.lit("=")), s).otherwise(F.concat(s, F.lit("=")))), "&")
    kept = F.filter(query_params(query), lambda p: ~is_tracking_param(p["name"]))
    coded = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["name"]), F.lit("="), _encode(p["value"]))), "&")
    return F.when(F.rlike(query, F.lit(_PLAIN_QUERY)), plain).otherwise(coded)


def canonical_url(url: Column) -> Column:
    """The form URLs are compared in.

    Trimmed, tracking parameters dropped, scheme and host lower-cased, trailing slashes of
    the path removed. Anything that is not an absolute http(s) URL is only trimmed.
    """
    raw = strip(F.coalesce(url, F.lit("")))

    def rebuild(p: Column) -> Column:
        host, path, query, fragment = [F.get(p, F.lit(i)) for i in range(4)]
        cleaned = F.when(query == "", "").otherwise(
            let(_clean_query(query), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        )
        anchor = F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), fragment))
        return F.when((F.size(p) == 4) & _balanced(host), F.concat(F.lower(host), _trimmed_path(path), cleaned, anchor))

    return F.coalesce(let(_parts(raw), rebuild), F.rtrim(raw, F.lit("/")))


def is_valid_http_url(url: Column) -> Column:
    """True for an absolute http(s) URL with a host."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[hH][tT][tT][pP][sS]?://([^/?#]+)", 1)
    return (host != "") & _balanced(host)


def url_hash(url: Column) -> Column:
    """16 hex characters that key a URL's cached stages."""
    return F.substring(F.sha2(canonical_url(url), 256), 1, 16)


def item_id(parent_url: Column, kind: Column, name: Column, position: Column) -> Column:
    """20 hex characters that identify one extracted item; position 0 and NULL are blank."""
    spot = F.when(position.isNotNull() & (position != 0), position.cast("string")).otherwise("")
    parts = [F.coalesce(parent_url, F.lit("")), F.coalesce(kind, F.lit("")), F.coalesce(name, F.lit("")), spot]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def resolved_target(url: Column, target: Column) -> Column:
    """Short-link expansion: the redirect target cut at '?', or the URL itself."""
    return F.when(target.isNotNull() & (target != "") & (target != url), F.substring_index(target, "?", 1)).otherwise(url)


def is_photo_post(url: Column, resolved: Column) -> Column:
    return F.contains(F.coalesce(F.nullif(resolved, F.lit("")), url), F.lit("/photo/"))


def is_carousel(media_type: Column, entries: Column, resolved: Column) -> Column:
    """Playlist, any entries, or a photo post."""
    return (
        F.coalesce(media_type == "playlist", F.lit(False))
        | (F.coalesce(F.size(entries), F.lit(0)) > 0)
        | F.coalesce(F.contains(resolved, F.lit("/photo/")), F.lit(False))
    )
