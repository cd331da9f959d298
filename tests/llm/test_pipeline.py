"""The pipeline's rows against its stages done one document at a time, and the registered queries."""

import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from linkshelf.llm import mixing  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def plain_survivors(rows):
    """Rules, exact dedup and near dedup, one row at a time."""
    rows = [r for r, ok in zip(rows, brute.robust_verdicts([(t, la, s) for _, t, la, s in rows])) if ok]
    rows = [r for r, d in zip(rows, brute.exact([(i, t) for i, t, _, _ in rows])) if d[3]]
    roots = brute.components([r[0] for r in rows], [brute.fingerprint(r[1]) for r in rows])
    return [r for r, root in zip(rows, roots) if r[0] == root]


def test_pipeline_is_its_stages_done_plainly(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = plain_survivors(table)
    assert len(rows) < len(table)
    sizes: dict[str, int] = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.encode()) + 1
    aims = {s: float(b) ** mixing.FLATTEN for s, b in sizes.items()}
    units = {s: max(1, round(mixing.RESOLUTION * a / sum(aims.values()))) for s, a in aims.items()}
    import hashlib

    plan, _ = brute.mix([(s, len(t.encode()) + 1, (hashlib.md5(str(i).encode()).hexdigest(), i)) for i, t, _, s in rows], units, mixing.BLOCK_BYTES)
    times: dict[int, int] = {}
    for i, _ in plan:
        times[rows[i][0]] = times.get(rows[i][0], 0) + 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t, _, _ in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(times)
    total: dict[int, int] = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] == tokens[r["doc_id"]]
    assert total == {i: n * tokens[i] for i, n in times.items()}
    filled = np.bincount([r["sequence_id"] for r in got], [r["length"] for r in got])
    assert set(filled[:-1]) == {2048.0} and filled[-1] <= 2048


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF).columns == none.columns and stage(spark, none, SF).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_dedup", "mixing", "packing"]


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
