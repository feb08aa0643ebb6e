"""The conversation trie against a brute-force version."""

import hashlib
import random
import zlib

import pytest

from rankflow.llm import conversation_trie as ct
from rankflow.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string, depth int"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[k] for k in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def made():
    pick = random.Random(9)
    rows = []
    for c in [*range(0, 260), *range(905, 990), -3, -140, -100, 1 << 61]:
        for turn in range(pick.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, pick.choice(["user", None, ""]), pick.choice(["hi", "yes 😀", "", None])))
    rows += [(300, None, "x", "last?"), (300, 1, "b", "tie"), (300, 1, "a", "tie"), (300, 1, "a", "tie"), (None, 1, "user", "nobody"), (301, 5, None, "z" * 100_000)]
    rows += [(400, t, "user", f"turn {t % 7}") for t in range(300)] + [(401, t, "user", f"turn {t % 7}") for t in range(299)]
    rows += [(1000 + i, 0, "system", "the same") for i in range(150)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "piece", "many", "parts"), [(4096, 1 << 14, 10_000, 4), (50, 200, 3, 16)])
def test_equals_brute_force(spark, made, monkeypatch, block, piece, many, parts):
    monkeypatch.setattr(ct, "BLOCK", block)
    df = spark.createDataFrame([(*r, 1) for r in made], SCHEMA).repartition(parts)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    if parts > 8:  # borders within conversations and among siblings
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(ct.trie(df, piece, many)) == brute(made)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_query_and_empty_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert found(queries.op12_conversation_trie(spark, SF)) == brute(rows)
    assert ct.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_list_ranks_of_a_list_in_any_order(spark):
    pick = random.Random(1)
    order = [(i * 7919 % 3001, i % 5) for i in range(3001)]
    pick.shuffle(order)
    weights = [(1, pick.randint(0, 3), pick.randint(0, 1 << 40)) for _ in order]
    rows = [(*x, *(y or (None, None)), *w) for x, y, w in zip(order, [*order[1:], None], weights, strict=True)]
    links = spark.createDataFrame(rows, "c long, a long, nc long, na long, w0 long, w1 long, w2 long")
    got = {(r["c"], r["a"]): (r["b0"], r["b1"], r["b2"]) for r in ct.list_ranks(links, 700).collect()}
    at = (0, 0, 0)
    for x, w in zip(order, weights, strict=True):
        assert got[x] == at
        at = tuple(p + q for p, q in zip(at, w, strict=True))
    assert len(got) == len(order)
