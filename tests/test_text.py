import pytest
from pyspark.sql import functions as F

from linkshelf.functions import frontmatter as FM
from linkshelf.functions import numbers as N
from linkshelf.functions import tags as G
from linkshelf.functions import text as T


@pytest.mark.parametrize("text, claim", [
    ("Top 10 places in Japan", True), ("my favorite albums", True), ("5 best apps", True), ("TIER LIST of snacks", True),
    ("just a vlog", False), ("stop 10 times", False), ("favourite day", False), ("top ten", False),
])
def test_list_claim(evaluate, text, claim):
    assert evaluate(T.has_list_claim, text) is claim


@pytest.mark.parametrize("stderr, kind", [
    ("ERROR: Private video ... HTTP Error 429", "permanent"), ("HTTP Error 503", "transient"), ("Timed Out", "transient"),
    ("Sign in to confirm your age", "permanent"), ("all good", None), (None, None),
])
def test_failure_class(evaluate, stderr, kind):
    assert evaluate(T.failure_class, stderr, schema="s string") == kind


@pytest.mark.parametrize("title, stem", [
    ('a/b: "c" <d>', "ab c d"), ("CON", "_CON"), ("con.txt", "_con.txt"), ("  ", "Saved Video"), ("x" * 70, "x" * 60),
    ("dots...", "dots"), ("a \n b", "a b"), (None, "Saved Video"),
])
def test_safe_filename(evaluate, title, stem):
    assert evaluate(T.safe_filename, title, schema="s string") == stem


@pytest.mark.parametrize("raw, folder, project", [
    ("Comedy", "Comedy", "Comedy"), ("../x", None, None), ("a:b", None, "ab"), (".hidden", None, None), ("nul", None, "_nul"), ("x.", None, "x"), ("", None, None),
])
def test_typed_names(evaluate, raw, folder, project):
    assert evaluate(T.folder_segment, raw) == folder
    assert evaluate(T.project_name, raw) == project


def test_small_text_functions(evaluate):
    assert evaluate(T.hashtags, "#a #b_é #a ##c") == ["a", "b_é", "c"]
    assert evaluate(T.word_count, "  two words \n") == 2
    assert evaluate(T.word_count, "  ") == 0
    assert evaluate(lambda c: T.caption_title(c, "Post"), "x" * 61) == "x" * 60 + "..."
    assert evaluate(T.needs_vision, "This one is INSTRUMENTAL only, enjoy") is True
    assert evaluate(T.needs_vision, "Mix flour and water, then bake it") is False
    assert evaluate(T.checklist, ["a  b", " ", None, "c"]) == "- [ ] a b\n- [ ] c"
    assert evaluate(T.checklist, [" "]) == "- [ ]"
    assert evaluate(T.clock, 75.9) == "1:15"
    assert evaluate(T.cue_seconds, "01:02:03,500") == 3723.5
    assert evaluate(T.cue_seconds, "x:1") == 0.0
    assert evaluate(lambda b: T.excerpt(b, 5), "## Notes & Insights\nabc def") == "abc d..."


@pytest.mark.parametrize("value", [0.005, 0.015, 0.025, 0.125, 0.145, 0.375, 0.825, 1.005, 2.675, 3.995, 4.445, 0.0, 0.1249999, 9.125, 12345.675, -9.125, -0.005, 1e9 + 0.125, 2.0**51 + 0.5, 1e300, 0.015625])
def test_rounding_follows_the_binary_value(evaluate, value):
    assert evaluate(lambda c: N.rounded(c, 2), value) == round(value, 2)
    if abs(value) < 1e37:
        assert evaluate(lambda c: N.fixed(c, 2), value) == f"{value:.2f}"


@pytest.mark.parametrize("value", [35.6595, -139.7004567, 0.0000005, 89.9999999, 1234567.0000005])
def test_coordinates_text(evaluate, value):
    assert evaluate(lambda c: N.fixed(c, 6), value) == f"{value:.6f}"


CARD = """---
category: "Travel"
url: 'https://a.b/it''s'
status: kept   # mine
weight: 3
location: "[35.6595, 139.7004]"
pair: [1, 2]
empty:
tags:
  - saved-media
  - "category/travel"
---

# Title

body url: "https://other"
"""


def test_frontmatter_reads_the_written_subset(spark):
    c = F.col("c")
    row = spark.createDataFrame([(CARD,)], "c string").select(
        FM.state(c).alias("state"), FM.scalars(FM.block_text(c)).alias("fm"), FM.lists(FM.block_text(c)).alias("lists"), FM.body_text(c).alias("body")
    ).first()
    assert row.state == "ok"
    assert row.fm == {
        "category": "Travel", "url": "https://a.b/it's", "status": "kept", "weight": "3", "location": "[35.6595, 139.7004]", "empty": None,
    }
    assert row["lists"] == {"pair": ["1", "2"], "tags": ["saved-media", "category/travel"]}
    assert row.body.startswith("\n# Title")


@pytest.mark.parametrize("content, state", [
    ("no block", "absent"), ("text\n---\na: 1\n---\n", "absent"), ("---\na: 1\n---", "ok"), ("---\r\na: 1\r\n---\r\nx", "ok"),
    ('---\nurl: "torn\n---\n', "broken"), ("---\na: b: c\n---\n", "broken"), ("---\njust words\n---\n", "broken"), ("---\n# note\n\na: 1\n---\n", "ok"),
])
def test_frontmatter_state(evaluate, content, state):
    assert evaluate(FM.state, content) == state


def test_broken_block_is_read_by_lines(evaluate):
    broken = '---\nurl: "https://a.b/c"\nstatus: inbox\nbad: "torn\n---\n'
    assert evaluate(lambda c: FM.queue_value(c, "url"), broken) == "https://a.b/c"
    assert evaluate(lambda c: FM.queue_value(c, "status"), broken) == "inbox"


def test_repeated_key_keeps_last_value(evaluate):
    assert evaluate(lambda c: FM.scalars(FM.block_text(c)), "---\na: 1\nb: 2\na: 3\n---\n") == {"b": "2", "a": "3"}


def test_rebuild_keeps_the_body(evaluate):
    assert evaluate(FM.rebuild_card, "---\na: 1\n---\n\nbody \n", "b: 2") == "---\nb: 2\n---\n\nbody \n"
    assert evaluate(FM.rebuild_card, "---\na: 1\n---\nbody", "b: 2") == "---\nb: 2\n---\n\nbody"
    assert evaluate(FM.rebuild_card, "no block", "b: 2") is None


def test_quoted_matches_json(evaluate):
    import json

    for text in ['a "b" \\ c', "line\nbreak\ttab", "é ☕", ""]:
        assert evaluate(FM.quoted, text) == json.dumps(text, ensure_ascii=False)


@pytest.mark.parametrize("category, folder, tag", [
    ("Music", "Music", "category/saved-music"), ("Recipes & Food", "Recipes & Food", "category/recipes-and-food"),
    ("Art/Organization/Spaces", "Art & Spaces", "category/art-organization-spaces"), ("Invented", "Inbox", "category/invented"),
    ("", "Inbox", "category/uncategorized"),
])
def test_category(evaluate, category, folder, tag):
    assert evaluate(G.folder_for, category) == folder
    assert evaluate(G.category_tag, category) == tag


@pytest.mark.parametrize("weight, color", [(-1, "#9E9E9E"), (0, "#9E9E9E"), (1, "#42A5F5"), (2, "#42A5F5"), (3, "#FFA726"), (5, "#FFA726"), (6, "#EF5350")])
def test_weight_color(evaluate, weight, color):
    assert evaluate(G.weight_color, weight) == color


def test_weight_must_be_a_number(evaluate):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        evaluate(G.weight_color, "many")


def test_tags(evaluate):
    assert evaluate(lambda t: G.replace_category_tag(t, F.lit("Travel")), ["x", "category/tips", "x"]) == ["x", "x", "category/travel"]
    assert evaluate(lambda t: G.rewrite_tags(t, {"old": "saved-media"}), ["old", "category/a-&-b", "saved-media", "category/"]) == ["saved-media", "category/a-and-b", "category/"]
    assert evaluate(G.place_query, "Kyoto", "Japan") == "Kyoto, Japan"
    assert evaluate(G.place_query, "Kyoto, JAPAN", "japan") == "Kyoto, JAPAN"
    assert evaluate(G.place_query, " ", "Japan") is None
