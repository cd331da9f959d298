import pytest
from pyspark.sql import functions as F

from linkshelf.functions import urls as U

VIDEO = "https://www.tiktok.com/@cook/video/123"
CANONICAL = {
    f"  {VIDEO}/ \n": VIDEO,
    "HTTPS://WWW.TikTok.com/@cook/video/123": VIDEO,
    f"{VIDEO}?is_from_webapp=1&sender_device=pc": VIDEO,
    f"{VIDEO}?UTM_source=copy&_T=abc&IGSH=z": VIDEO,
    f"{VIDEO}///?utm_medium=x": VIDEO,
    "https://youtu.be/watch?v=abc&si=share&t=5": "https://youtu.be/watch?v=abc&t=5",
    "https://h.com/p/?img_index=2&igsh=1": "https://h.com/p?img_index=2",
    "https://h.com/?a&&b=": "https://h.com?a=&b=",
    "https://h.com/x?q=a+b%20c&s=%C3%A9*~": "https://h.com/x?q=a+b+c&s=%C3%A9%2A~",
    "https://h.com/x?q=%41%ZZ&r=1=2": "https://h.com/x?q=A%25ZZ&r=1%3D2",
    "https://h.com/x/#top/": "https://h.com/x#top/",
    "https://h.com/a/b/;p=1?x=2": "https://h.com/a/b;p=1?x=2",
    "https://h.com/;p": "https://h.com/;p",
    "https://User@H.com:80/P": "https://user@h.com:80/P",
    "https://h.com?": "https://h.com",
    "https://h.com/a\tb": "https://h.com/ab",
    "not a url/": "not a url",
    "ftp://h.com/": "ftp://h.com",
    "http:///path/": "http:///path",
    "https://[::1/x/": "https://[::1/x",
    "": "",
}


def test_canonical_form(spark):
    df = spark.createDataFrame([(k,) for k in CANONICAL], "u string")
    got = {r.u: r.c for r in df.select("u", U.canonical_url(F.col("u")).alias("c")).collect()}
    assert got == CANONICAL


def test_canonical_is_idempotent_and_null_safe(spark):
    df = spark.createDataFrame([(k,) for k in CANONICAL] + [(None,)], "u string")
    once = df.select(U.canonical_url(F.col("u")).alias("c"))
    assert once.select((U.canonical_url(F.col("c")) == F.col("c")).alias("same")).filter("not same").isEmpty()


@pytest.mark.parametrize("url, valid", [
    ("https://a.b/c", True), ("HTTP://a", True), ("http://", False), ("https:///x", False), ("ftp://a", False),
    ("--exec rm", False), ("javascript:alert(1)", False), ("", False), (None, False),
])
def test_valid_url(evaluate, url, valid):
    assert evaluate(lambda c: U.is_valid_http_url(c), url, schema="u string") is valid


def test_item_id_blanks(evaluate):
    # sha256 of "u|song|A|" and "u|song|A|2"
    import hashlib

    make = lambda a, b, c, d: U.item_id(a, b, c, d)
    assert evaluate(make, "u", "song", "A", 0) == hashlib.sha256(b"u|song|A|").hexdigest()[:20]
    assert evaluate(make, "u", "song", "A", 2) == hashlib.sha256(b"u|song|A|2").hexdigest()[:20]


def test_short_link_and_photo(evaluate):
    assert evaluate(U.resolved_target, "s", "https://h/v?x=1") == "https://h/v"
    assert evaluate(U.resolved_target, "s", "s") == "s"
    assert evaluate(U.is_photo_post, "https://h/photo/1", "") is True
    assert evaluate(U.is_photo_post, "https://h/photo/1", "https://h/v") is False
