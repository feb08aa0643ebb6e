"""Exact deduplication by keyed state against a brute-force version."""

import hashlib
import itertools
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankflow.llm import exact_dedup, queries

SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    """rows in the order of files and places."""
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(low(t), []).append((i is not None, i or 0, k, i))
    out = []
    for k, (i, t) in enumerate(rows):
        g = groups[low(t)]
        out.append((i, max(g)[3], len(g), max(g)[2] == k, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def put(folder, name, rows):
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "digest": [1] * len(rows), "_metadata": [2] * len(rows)}), f"{folder}/{name}.parquet")


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=repr)


ROWS = [(5, "a b"), (9, "A B"), (9, "a b"), (None, "A b"), (1, None), (2, ""), (None, "x"), (None, "X"), (3, "É"), (4, "é"), (7, "z" * 200_000), (8, "Z" * 200_000), (6, "kK"), (11, "KK"), (1 << 62, "only")]


@pytest.mark.parametrize("size", [1, 1 << 30])
def test_equals_brute_force_in_any_batches(spark, tmp_path, size):
    for k in range(0, len(ROWS), 4):
        put(tmp_path, f"part-{k:04d}", ROWS[k : k + 4])
    assert found(exact_dedup.dedup(spark, str(tmp_path), batch_bytes=size)) == brute(ROWS)


def test_later_files_change_the_state(spark, tmp_path):
    docs, state = tmp_path / "docs", f"file://{tmp_path}/state"
    docs.mkdir()
    put(docs, "part-0", ROWS[:6])
    exact_dedup.observe(spark, str(docs), state)
    assert found(exact_dedup.duplicates(spark, str(docs), state)) == brute(ROWS[:6])
    put(docs, "part-1", ROWS[6:] + [(10, "a B"), (20, "only")])
    exact_dedup.observe(spark, str(docs), state)
    assert len([d for d in os.listdir(tmp_path / "state" / "updates") if d.startswith("batch=")]) == 3  # the empty one and two
    assert found(exact_dedup.duplicates(spark, str(docs), state)) == brute(ROWS + [(10, "a B"), (20, "only")])


def test_bytes_decide_where_digests_collide(spark, tmp_path):
    rows = [(i, "".join(t)) for i, t in enumerate(itertools.product("aBb", repeat=3))] + [(99, None), (98, "long " * 9)]
    put(tmp_path, "part-0", rows[:20])
    put(tmp_path, "part-1", rows[20:])
    weak = lambda text: F.length(text)
    assert found(exact_dedup.dedup(spark, str(tmp_path), weak, 1)) == brute(rows)


def test_query_and_empty_table(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert found(queries.op13_exact_dedup(spark, SF)) == brute(rows)
    put(tmp_path, "part-0", [])
    assert exact_dedup.dedup(spark, str(tmp_path)).count() == 0
