"""Ranked lexical search against a brute-force version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.llm import lexical_search as ls
from rankflow.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t):
    return [low(w) for w in WORD.findall(t or "")]


def brute(docs, items, k=10):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for i, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n_docs) // total
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, c in Counter(words(text)).items() if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def made():
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "ä", "ß9", "日本", "a_b", "O'x"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(pick.choices(vocabulary, weights, k=n))
    docs = [(i, text(pick.choice([1, 3, 20, 90]))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(None, docs[7][1]), (None, None), (3, docs[9][1]), (2000, ""), (2001, " ,;"), (2002, "w1 " * 60_000), (2003, "W1-w1\x00w1")]
    items = [(i, text(pick.choice([1, 4, 30]))) for i in range(25)] + [(100, "w1 w1 w1 W2"), (100, "w59"), (None, "w3"), (101, None), (102, ""), (103, "nowhere"), (0, None)]
    return docs, items


@pytest.mark.parametrize(("block", "bucket", "shard"), [(32_000_000, 2048, 16_384), (12_000, 16, 100)])
def test_equals_brute_force(spark, made, block, bucket, shard):
    docs, items = made
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, terms int").repartition(4)
    q = spark.createDataFrame([(i, t, 2) for i, t in items + items[:3]], "item_id long, text string, item int")
    assert found(ls.search(d, q, 10, block, bucket, shard)) == brute(docs, items)


def test_pruning_is_used_and_loses_nothing():
    pick = np.random.default_rng(5)
    import pyarrow as pa

    n, size = 4000, 300
    own = [np.unique(pick.zipf(1.3, 30) % size).astype(np.int32) for _ in range(n)]
    tf = [pick.integers(1, 9, len(o)).astype(np.int32) for o in own]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([int(t.sum()) for t in tf]), ls._ints(own), ls._ints(tf)], ["doc_id", "n", "terms", "tf"])
    df = np.bincount(np.concatenate(own), minlength=size)
    shard = ls.Shard([batch], ls.Weights(n, sum(int(t.sum()) for t in tf), df))
    kept = 0
    for _ in range(20):
        terms = pick.choice(size, 12, replace=False)
        counts = np.ones(12, np.int64)
        vector = np.zeros(size, np.int64)
        vector[terms] = counts
        for a, b in shard.buckets(500):
            bucket = ls.Bucket(shard, a, b, size)
            exact = bucket.scores(np.arange(b - a), vector) if (np.diff(shard.ends[a : b + 1]) > 0).all() else None
            least = int(np.sort(exact)[-5])
            alive = bucket.survivors(terms, counts, least)
            assert set(np.flatnonzero(exact >= least)) <= set(alive)
            kept += len(alive)
    assert kept < 20 * n // 2


def test_edge_tables_and_query(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert ls.search(none, items).count() == 0
    assert ls.search(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string"), items).count() == 0
    assert ls.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0
    got = queries.op11_lexical_search(spark, SF)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert found(got) == brute(docs, bench)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    strings = ls.search(spark.createDataFrame([("b", "x y"), ("a", "y x")], "doc_id string, text string"), items.select(F.lit("q").alias("item_id"), F.lit("X").alias("text")))
    assert [(r["doc_id"], r["rank"]) for r in strings.orderBy("rank").collect()] == [("a", 1), ("b", 2)]
