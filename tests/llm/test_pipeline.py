"""The pipeline against a brute-force version, and its stages on odd rows."""

import hashlib
import itertools
import re

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

import corpus_pipeline
from rankflow.llm import queries

from .test_operators import ODD, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    toxic = {r["doc_id"] for r in queries.op1_toxicity(spark, SF).collect() if r["predicted"]}
    docs = {i: t for i, t in docs.items() if i not in toxic}

    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t in docs.items():
        for line in t.split("\n"):
            first[key(line)] = min(i, first.get(key(line), i))
    docs = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in docs.items()}

    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    docs = {i: t for i, t in docs.items() if top(i) == i}

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist():
        w = words(r["text"])
        windows |= {tuple(w[a : a + min(13, len(w))]) for a in range(max(1, len(w) - 12)) if w}
    sizes = {len(w) for w in windows}

    def contaminated(t):
        w, hit = words(t), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
        return len(hit) > 0 and 20 * len(hit) >= len(w)

    docs = {i: t for i, t in docs.items() if not contaminated(t)}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in docs.items():
        ids = sp.encode(t, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < 200


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_keep_columns_on_odd_rows(spark, rows):
    shape = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, start int, score double, component_id long, pos int, `end` string"
    data = [(i, t, None, None, None, 1, "k", 1, 0.5, 7, 2, "e") for i, t in enumerate(ODD)] + [(None, "no id here at all", "en", "s", 3, 1, "k", 1, 0.5, 7, 2, "e")] * 2
    docs = spark.createDataFrame(data if rows == "odd" else [], shape)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        n = out.count()
        assert n <= docs.count() and (rows == "none") == (n == 0), name
    assert corpus_pipeline.encode(spark, docs, SF).count() == docs.count()


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcde")
    data = [(None, a), (None, a), (None, b), (7, b), (None, b), (8, b), (3, c), (9, c), (9, d), (9, d), (2, e), (2, e), (3, e)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(data)], "doc_id long, text string, n int").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r["text"][0], r["doc_id"]) for r in got.collect()), key=str) == [("a", None), ("b", 7), ("c", 3), ("d", 9), ("e", 2)]


def test_stages_with_any_column_names(spark):
    names = ["found", "__found", "row", "count", "k1", "h1", "__k1", "__keep", "__all", "__key", "__drop", "__doc", "__sum", "__lines", "__r1", "a.b", "fp"]
    docs = spark.createDataFrame([(i, f"some words of document {i}\nand a line {i}", *[f"{n}{i}" for n in names]) for i in range(6)], ["doc_id", "text", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names], name
