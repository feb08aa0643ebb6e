"""The ten operators against brute-force versions on small fixtures."""

import base64
import hashlib
import io
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankflow.llm import decontaminate, language_id, line_dedup, pii, queries, sentencepiece_codec, simhash, token_files, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n\n", "a", "x y\nx y\n", "0123456789 line\nshort\n 0123456789 LINE \n", "Ünï ﬁ 日本 😀 \x00", "a b c " * 5000, "z" * 30000, "<|endoftext|> </s> ▁▁  x"]


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t]
    return rows + [(10_000 + i, x) for i, x in enumerate(ODD)] + [(20_000 + i, x) for i, x in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, DOCS + ", lang string, sum int, `end` int").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", lang string")


def test_sentencepiece_equals_library(docs, texts, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode_digests(docs, path).collect()}
    for i, t in texts:
        ids = sp.encode(t or "", add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_digests(empty, path).count() == 0


def test_sentencepiece_fuzz():
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    pick = random.Random(3)
    bits = [" ", "  ", "▁", "a", "th", "e", "\n", "é", "日", "😀", "<0x0A>", "</s>", "ing", "\t", "x" * 9, "1", ".", "...", "==", "//", "THE", "'s", "#"]
    for _ in range(4000):
        t = "".join(pick.choice(bits) for _ in range(pick.randint(0, 30)))
        assert own.encode(t) == sp.encode(t, add_eos=True), t
        assert own.decode(own.encode(t)) == sp.decode(sp.encode(t)), t
    for n in [*range(1, 80), 257, 1000, 4001]:
        assert own.encode(" " * n + "a") == sp.encode(" " * n + "a", add_eos=True)


def test_sentencepiece_long_runs_of_spaces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    for n in range(60):
        for t in (" " * n, " " * n + "a", "a" + " " * n + "b", "a" + " " * n):
            assert own.encode(t) == sp.encode(t, add_eos=True)
    began = time.process_time()
    assert len(own.encode(" " * 1_000_000)) > 60_000 and time.process_time() - began < 5


def test_sentencepiece_many_texts_equal_single_ones():
    own = sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))
    pick = random.Random(4)
    bits = [" ", "\n", " ", "a", "th", "é", "日", "ing", "\t", "1", "...", "The", "▁"]
    rows = [None, "", *("".join(pick.choice(bits) for _ in range(pick.randint(0, 20))) for _ in range(3000))]
    got = zip(*[c.to_pylist() for c in own.digests(pa.array(rows, pa.string()))], strict=True)
    assert list(got) == [own.digest(t or "") for t in rows]


def test_sentencepiece_batches_equal_library_whatever_came_before():
    """Blank lines, final feeds and spaces before feeds, in many batches in shuffled order through one codec."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    pick = random.Random(6)
    bits = [" ", " ", "\n", "\n\n", " \n", "\n ", "a", "the", "é", "日", "ing", "\t", ".", "...", "▁", "x1", "😀"]
    rows = ["x\n\ny", "a \nb", "x\n\ny", "the\n\n", "\n", "\na", *("".join(pick.choice(bits) for _ in range(pick.randint(0, 12))) for _ in range(20_000))]
    for _ in range(2):
        for a in range(0, len(rows), 700):
            batch = rows[a : a + 700]
            counts, ids, plain = (c.to_pylist() for c in own.digests(pa.array(batch, pa.string())))
            for t, n, x, y, want in zip(batch, counts, ids, plain, sp.encode(batch, add_eos=True), strict=True):
                assert n == len(want) and x == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), repr(t)
                assert y == hashlib.sha256(sp.decode(want).encode()).hexdigest(), repr(t)
        pick.shuffle(rows)


def test_sentencepiece_round_trip(docs, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: (t or "").replace("▁", " ") for i, t in texts}


def test_token_files_equal_library(docs, texts, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    encode = token_files.tokenizer_encoder(path)
    got = {r["doc_id"]: r for r in token_files.read_files(token_files.write_files(docs, encode, 50_257, 0)).collect()}
    start = 0
    for i, t in sorted(texts, key=lambda x: x[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert token_files.read_files(token_files.write_files(empty, encode, 50_257, 0)).count() == 0


def test_token_words_equal_whole_texts():
    memo = token_files.word_memo(public_tokenizers.path("byte_bpe_50k.json"))
    pick = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "a", "th", "é", "日", "😀", "'s", "ing", "\t", "1", "...", "THE", "'", " ", "\u3000", "\x1c", "<|endoftext|>", "$#", ")."]
    rows = [None, "", *("".join(pick.choice(bits) for _ in range(pick.randint(0, 14))) for _ in range(8000))]
    counts, ids = memo.encode(pa.array(rows, pa.string()))
    cuts = np.split(ids, np.cumsum(counts)[:-1])
    for t, own in zip(rows, cuts, strict=True):
        assert own.tolist() == memo.own.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_ranges_cut_within_repeated_ids():
    least = [(3, 5), (7, 1), (7, 4), (7, 4), (9, 0)]
    ranges = token_files.Ranges(least)
    rows = [(d, r) for d in (-9, 3, 5, 7, 8, 9, 10) for r in range(7)]
    got = ranges.of(np.array([d for d, _ in rows]), np.array([r for _, r in rows])).tolist()
    assert got == [sum(x <= row for x in least) for row in rows]
    assert token_files.Ranges([]).of(np.array([1]), np.array([1])).tolist() == [0]


def test_token_files_of_repeated_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(7 if i % 3 else None, f"text {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    manifest = token_files.write_files(docs, token_files.tokenizer_encoder(path), 50_257, 0)
    got = token_files.read_files(manifest).collect()
    assert manifest.count() > 2 and len(got) == 400 and sum(r["doc_id"] is None for r in got) == 134
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    own = Tokenizer.from_file(path)
    assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in rows)


def test_packing_round_trip_and_random_access():
    pick = np.random.default_rng(0)
    for size in (2, 3, 200, 257, 50_257, 70_000, 1 << 20):
        bits = token_files.bits_for(size)
        assert (1 << bits) >= size > (1 << bits - 1) or bits == 1
        out = io.BytesIO()
        writer = token_files.Writer(out, bits, block=64)
        rows = [pick.integers(0, size, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 1000, 0, 7)]
        for i, ids in enumerate(rows):
            writer.add(i - 3, ids)
        writer.close()
        reader = token_files.Reader(out, len(out.getvalue()))
        for i in pick.permutation(len(rows)):
            assert (reader.ids(i) == rows[i]).all() and reader.doc_ids[i] == i - 3


def test_contamination(spark, docs, texts, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    items += [(900, "x y"), (901, "X, Y!"), (902, ""), (903, None), (904, "a b c " * 8), (905, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    split = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, block_bytes=1500).collect()}
    assert got == split
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= ids
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found)), i
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert any(r["contaminated"] for r in got.values())
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r["n_hit"] for r in decontaminate.decontaminate(docs, bench.where("false")).collect())



@pytest.mark.parametrize("bits", [64, 1 << 12, decontaminate.BLOOM_BITS])
def test_decontaminate_filter_of_any_size_loses_no_window(spark, monkeypatch, bits):
    """Few words, so that every word is the prefix of many windows; a full filter lets all through, and results stay."""
    monkeypatch.setattr(decontaminate._bloom, "__defaults__", (bits,))
    rng = random.Random(5)
    text = lambda k: " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(k))
    items = [(f"i{i}", text(rng.choice((1, 3, 12, 13, 14, 40)))) for i in range(40)]
    docs = [(i, text(rng.randint(0, 60)) + " " + rng.choice(items)[1] + " " + text(rng.randint(0, 9))) for i in range(120)] + [(900, None), (901, ""), (902, "a " * 5000)]
    index = decontaminate.prefix_index(items, {}, 13)
    want = []
    for i, t in docs:
        hit, found = decontaminate._covered(decontaminate.words_of(t), index)
        want.append((i, len(hit), sum(hit), len(found)))
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), block_bytes=10)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()) == sorted(want)


def test_contamination_equals_sql_and_large_benchmarks_stay_tables(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(9)) for _ in range(n))
    items = [(None, text(30)), (None, text(20)), *[(7, text(40)) for _ in range(40)], (8, text(5)), (7, None)]
    data = [(i, f"{text(20)} {t or ''} {text(20)}") for i, (_, t) in enumerate(items)] + [(90, items[2][1] + " " + items[0][1]), (91, items[0][1]), (92, items[0][1]), (93, None)]
    docs, bench = spark.createDataFrame(data, DOCS), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = sorted(con.sql(queries.ORACLE_SQL["op4_decontaminate"]).fetchall())
    sizes, make = [], decontaminate.prefix_index
    monkeypatch.setattr(decontaminate, "prefix_index", lambda block, *a: sizes.append(len(block)) or make(block, *a))
    assert sorted(map(tuple, decontaminate.decontaminate(docs, bench).collect())) == want and any(r[5] for r in want)
    split = decontaminate.decontaminate(docs, bench, block_bytes=1000)
    assert sorted(map(tuple, split.collect())) == want
    assert len(sizes) == 1  # that of the small benchmark


def base_spans(text):
    rules = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, rx in rules.items():
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark, texts):
    extra = [
        "a.b@c.de_x@y.com a@b@c.d.e. @x.y 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 9.9.9",
        "😀 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5  +1 (132) 555-1352. +12 +49 30 1234567 ++1 2345678 ",
        "1" * 5000 + " " + "a." * 5000 + "@x" + ".y" * 4000 + " " + "4 " * 4000 + "+" * 3000,
        None,
        "",
    ]
    rows = texts + [(30_000 + i, t) for i, t in enumerate(extra)] + [(30_000, extra[0])]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], DOCS + ", start int, kind string").repartition(4)
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        spans = base_spans(t)
        r = by[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS], i
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        have = [x for x in r["spans"].split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(have) and len(have) == len(spans) + r["n_added"]
    assert pii.find_personal_data(docs.where("false")).count() == 0


@pytest.mark.parametrize("copies", [1, 60])
def test_loose_personal_data_is_added(spark, copies):
    planted = {
        "email": ("write to ann.lee [at] mail (dot) example [dot] org", ". Then more"),
        "ip": ("from host 2001:0db8:85a3:0000:0000:8a2e:0370:7334", " today"),
        "card": ("my visa 4111.1111/1111.1111", " is new"),
        "phone": ("please call 030/123-4567", " now"),
    }
    first = {"email": 9, "ip": 10, "card": 8, "phone": 12}
    rows = [(10 * i + k, f"{i} {a}{b}", kind, len(str(i)) + 1 + first[kind], len(str(i)) + 1 + len(a)) for i in range(copies) for k, (kind, (a, b)) in enumerate(planted.items())]
    wrong = [(10 * i + 9, "at 10:20:30:40:50:10:20:30 see 4111.1111/1111.1112, part 030/123-4567, we @ home.now") for i in range(copies)]
    base = [(10 * i + 8, f"a{i}@x.com 10.0.0.{i} +49 30 1234567 and 4111 1111 1111 1111") for i in range(copies)]
    docs = spark.createDataFrame([r[:2] for r in rows] + wrong + base, DOCS)
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    for i, _, kind, start, end in rows:
        assert (got[i]["spans"], got[i]["n_added"]) == (f"{kind}:{start}:{end}", 1)
    assert [(t, got[i]["spans"]) for i, t in wrong + base if got[i]["n_added"]] == []


def test_trees_decide_where_views_do_not_agree(spark):
    taught = [(i, f"please call (030) 123-{4000 + i} now") for i in range(150)] + [(200 + i, f"part 12/345/{6000 + i} in stock") for i in range(150)]
    both = [(400, "see (040) 555-1234 there"), (401, "see 14/355/6789 there"), (402, "part (040) 555-1234"), (403, "so 10:20:30:40:50:10:20:30 then"), (404, None)]
    docs = spark.createDataFrame(taught + both, DOCS)
    found = pii.label(pii.candidates(docs).where("valid or not base"))
    assert {r["doc_id"]: r["view"] for r in found.where("doc_id >= 400").collect()} == {400: None, 401: None, 402: 0.0, 403: 0.0}
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert [got[i] for i in range(400, 405)] == ["phone:4:18", "", "", "", ""]
    assert all(bool(got[i]) == (i < 200) for i, _ in taught)


@pytest.mark.parametrize(("text", "spans"), [("please call (030) 123-4567", "phone:12:26"), ("part 12/345/6789", ""), ("", "")])
def test_one_label_or_none_holds_for_open_candidates(spark, text, spans):
    docs = spark.createDataFrame([(i, text) for i in range(30)] + [(99, "see (040) 555-1234 there")], DOCS)
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert got[0] == spans and got[99] == ("phone:4:18" if spans else "")


def test_lines(spark, texts, docs, empty):
    strip = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(strip))
    holders = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) >= 2 and min(holders[key(x)]) != i)]
        assert (got[i]["__lines"], got[i]["__dropped"], got[i]["text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept)), i
        assert got[i]["lang"] == "x"
    assert line_dedup.dedup_lines(empty).count() == 0
    same = spark.createDataFrame([(1, "a long enough line\nb"), (1, "a long enough line\nb"), (None, "A long enough line ")], DOCS)
    assert sorted(r["text"] for r in line_dedup.dedup_lines(same).collect()) == ["", "a long enough line\nb", "a long enough line\nb"]


def test_lines_with_any_column_names(spark):
    names = ["all", "key", "drop", "doc", "sum", "row", "id", "__lines", "__dropped", "a.b", "pos"]
    df = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in ((1, "one long line\nx"), (2, "one long line\ny"))], ["doc_id", "text", *names])
    got = sorted(line_dedup.dedup_lines(df, counts=()).collect(), key=lambda r: r["doc_id"])
    assert [(r["text"], *[r[n] for n in names]) for r in got] == [("one long line\nx", *[f"{n}1" for n in names]), ("y", *[f"{n}2" for n in names])]
    assert line_dedup.dedup_lines(df).columns[-2:] == ["__lines_", "__dropped_"]


def test_warc(spark):
    html = [None, "", "<p>é</p>", "same", "same", "x" * 200_000, "", "same\r\n\r\n"]
    rows = [(i, None if i == 2 else f"http://h/{i}\r\nX: 1", h, 5) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `last` int").repartition(3)
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    last = {}
    for i, h in enumerate(html):
        last[h or ""] = i
    for i, h in enumerate(html):
        raw = (h or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert r["html"] == ((h or "") if r["record_type"] == "response" else "")
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0
    data = warc.record(1, "u", b"abc", None)
    assert list(warc.members(io.BytesIO(data * 3))) == [zlib.decompress(data, 31)] * 3
    with pytest.raises(ValueError, match="digest"):
        warc.read_record(zlib.decompress(data, 31).replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="inside"):
        list(warc.members(io.BytesIO(data[:-5])))


def test_warc_splits_a_hot_digest_and_takes_an_empty_table(spark):
    rows = [(i, f"http://x/{i}", "the same" if i % 3 else f"page {i}") for i in range(600)]
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    last = max(i for i, _, h in rows if h == "the same")
    assert all((got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if h != "the same" or i == last else ("revisit", last)) for i, _, h in rows)
    none = spark.createDataFrame([], "page_id long, url string, html string, path int")
    assert warc.read_archives(warc.write_archives(none)).count() == 0


def test_top_k(spark):
    pick = np.random.default_rng(1)
    rows = [(i, [float(x) for x in pick.normal(size=6)]) for i in range(700)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (2200, [1.0, 2.0]), (2201, [3.0, -1.0]), (2250, []), (50, rows[7][1]), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, score int")
    vectors = topk.clean_vectors(df)
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v and not any(x is None or not np.isfinite(x) for x in v)]
    want = set()
    for q in {i for i, _ in whole if i % 50 == 0}:
        for qv in [v for i, v in whole if i == q][:1]:
            scored = sorted((-int(qv @ v), i) for i, v in whole if i != q and len(v) == len(qv))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)} if q != 50 else set()
    for shard, block in ((8192, 8192), (100, 7)):
        got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, shard, block)
        assert {tuple(r) for r in got.where("query_id <> 50").collect()} == want
    assert topk.top_k(vectors.where("false"), vectors.where("false"), 5).count() == 0


def test_top_k_large_components_and_repeated_queries(spark):
    pick = np.random.default_rng(7)
    rows = [(i, [float(x) for x in pick.normal(size=3)]) for i in range(300)]
    rows += [(1000, [1e30, 0.0, 1.0]), (1001, [-1e300, 1e300, 0.0]), (1050, [1.7e308, -1.0, 2.0]), (1002, [3e15, 1.0, 1.0]), (50, rows[50][1]), (100, [0.5, 0.25, 1.0])]
    vectors = topk.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(3)
    exact = lambda v: [math.floor(256 * x) if abs(x) < 2**52 else 256 * int(x) for x in v]
    want = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 50 == 0}:
        a = exact(v)
        scored = sorted((-min(max(sum(x * y for x, y in zip(a, exact(w), strict=True)), -(2**63) + 2), 2**63 - 1), i) for i, w in rows if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    for shard in (8192, 40):
        got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, shard, 3)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts, empty):
    prints = {i: brute_fingerprint(t) for i, t in texts}
    root = {p: p for p in prints.values()}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= 2:
            root[top(a)] = top(b)
    least = {}
    for i, p in prints.items():
        least[top(p)] = min(i, least.get(top(p), i))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", least[top(p)]) for i, p in prints.items()}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_in_hot_keys(spark):
    pick = random.Random(5)
    base = pick.getrandbits(64)
    values = {base}
    while len(values) < 160:
        v = pick.choice(sorted(values))
        for _ in range(pick.choice((1, 2, 3))):
            v ^= 1 << pick.randrange(64)
        values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    whole = {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}

    def groups(pairs):
        root = {v: v for v in signed}
        for _ in signed:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    for hot in (2, 10**6):
        got = {(r["a"], r["b"]) for r in simhash.links(fps, hot).collect()}
        assert got <= whole and groups(got) == groups(whole)
        assert hot == 2 or got == whole


def test_toxicity_held_out(spark):
    rows = queries.op1_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas()
    held = rows[rows["held_out"]].merge(labels, on="doc_id")
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()
    yes, no = held[held["toxic"] == 1]["score"], held[held["toxic"] == 0]["score"]
    auc = np.mean([(a > no).mean() + (a == no).mean() / 2 for a in yes])
    assert auc > 0.75
    assert (no >= 0.7).mean() < 0.02


def test_maximal_segments_by_brute_force():
    pick = random.Random(2)
    for _ in range(200):
        scores = [(i, pick.choice((-2.0, 1.0, 3.0, 0.5))) for i in range(14) if pick.random() < 0.6]
        full = [-0.25] * 14
        for i, s in scores:
            full[i] = s
        best = max((sum(full[a : b + 1]) for a in range(14) for b in range(a, 14)), default=0)
        found = toxicity.maximal_segments(scores, 0.25)
        assert all(s.score == pytest.approx(sum(full[s.first : s.last + 1])) and s.score > 0 for s in found)
        assert all(a.last < b.first for a, b in itertools.pairwise(found))
        assert max((s.score for s in found), default=0) == pytest.approx(max(best, 0))


def test_all_maximal_segments():
    """The disjoint segments that recursive splitting at the best one finds."""
    pick = random.Random(11)

    def split(full, first, last):
        sums = [(sum(full[a : b + 1]), -(b - a), a, b) for a in range(first, last + 1) for b in range(a, last + 1)]
        best = max(sums, default=(0,))
        if best[0] <= 0:
            return []
        _, _, a, b = max(s for s in sums if abs(s[0] - best[0]) < 1e-12)
        return [*split(full, first, a - 1), (a, b), *split(full, b + 1, last)]

    for _ in range(150):
        full = [round(pick.uniform(-3, 2), 3) for _ in range(16)]
        assert [(s.first, s.last) for s in toxicity.maximal_segments(list(enumerate(full)), 0.0)] == split(full, 0, 15)


def test_segment_scan_is_linear():
    began = time.process_time()
    found = toxicity.maximal_segments([(2 * i, 1.0) for i in range(200_000)], 2.0)  # the running sum falls all the way
    assert len(found) == 200_000 and time.process_time() - began < 5


def test_chance_finds_are_as_many_as_expected():
    pick = random.Random(12)
    draw = lambda n: [(i, pick.choice((2.1, 1.3, -1.7, -1.7, -0.6, -0.6))) for i in range(n) if pick.random() < 0.12]
    own = toxicity.Scorer({})
    own.suit({2.1: 200, 1.3: 200, -1.7: 400, -0.6: 400, None: 8800})
    best = lambda scored: max((s.score for s in toxicity.maximal_segments(scored, own.drift)), default=0.0)
    sizes = [pick.choice((200, 600, 1800)) for _ in range(1500)]
    k = len(sizes) / sum(n * math.exp(-own.lam * best(draw(n))) for n in sizes)
    for level in (0.5, 0.1):
        seen = sum(k * n * math.exp(-own.lam * s.score) <= level for n in sizes for s in toxicity.maximal_segments(draw(n), own.drift))
        assert level / 2 < seen / len(sizes) < level * 2


def test_toxicity_edge_cases(spark, empty):
    none = toxicity.train(empty.select(F.col("doc_id").alias("key"), "text", F.lit(1).alias("toxic")))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50_000), (None, "x")], DOCS)
    got = toxicity.score(docs, none).collect()
    assert len(got) == 4 and all(0 <= r["score"] < 0.7 for r in got)
    assert toxicity.passages(docs, none).count() == 0


def test_language_held_out(spark):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas()
    held = rows[rows["held_out"]].merge(docs, on="doc_id")
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_languages_with_long_texts_and_rare_ones_are_learned(spark):
    words = {"aa": "lorem dolor amet", "bb": "quick brown foxes", "cc": "zwölf boxkämpfer jagen"}
    langs = ["aa", "aa", "aa", "bb", "bb", "cc"]
    known = spark.createDataFrame([(i, words[k] + (f" {words[k]}" * 20_000 if k == "cc" else ""), k) for i, k in enumerate(langs)] + [(9, "123", "dd"), (9, None, "ee"), (None, "", None)], "key long, text string, lang string")
    model = language_id.train(known)
    assert model.languages == list(words) and model.predict(list(words.values()))[0] == list(words)


def test_language_excerpts_come_from_all_of_a_text(spark):
    text = "alpha " * 40_000 + "omega " * 40_000
    known = spark.createDataFrame([(i, text, "xx") for i in range(400)], "key long, text string, lang string")
    model = language_id.train(known)
    assert {"a", "l", "p", "h", "o", "m", "e", "g", " "} == {chr(c) for c in model.alphabet}
    assert model.phrases([language_id.running("omega omega")]).tolist() == [[1]]


def test_language_phrases_run_over_stretches(monkeypatch):
    pick = random.Random(12)
    word = lambda: "".join(pick.choice("abcde") for _ in range(pick.randint(1, 6)))
    samples = {k: " ".join(word() for _ in range(400)) for k in "xyz"} | {"w": "a" * 11}
    own = language_id.Model(samples)
    texts = [" ".join(word() for _ in range(n)) for n in (3, 900, 4000, 1, 60)] + ["a" * 7000, "a" * 2500 + " " + word(), "日" * 5000, "a" * 2046, "a" * 4094]
    lines = [language_id.running(t) for t in texts]
    want = np.array([own._whole(t) for t in lines]).T
    assert (own.phrases(lines) == want).all()
    monkeypatch.setattr(language_id, "STRETCH", 7)
    assert (own.phrases(lines) == want).all()

    def phrases(t, sample):
        n = i = 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in sample:
                k += 1
            n, i = n + 1, i + k
        return n

    for k, lang in enumerate(own.languages):
        sample = f" {samples[lang]} "
        assert want[k].tolist() == [phrases(f" {t} ", sample) for t in texts]


def test_language_parse_does_not_depend_on_the_batch():
    pick = random.Random(6)
    text = lambda n: " ".join("".join(pick.choice("abcdeé日") for _ in range(pick.randint(1, 6))) for _ in range(n))
    own = language_id.Model({"x": text(300), "y": text(300), "z": "日" * 50})
    tries = [text(n) for n in (1, 5000, 30, 2, 700)]
    assert own.predict(tries) == tuple(list(x) for x in zip(*[(p[0][0], p[1][0]) for p in map(own.predict, [[t] for t in tries])], strict=True))
    assert len(own.cells) < 40 * sum(map(len, (text(300), text(300))))


def test_language_automaton_by_brute_force(spark, empty):
    sample = " abracadabra banana "
    own = language_id.Model({"x": sample})

    def phrases(t):
        n = i = 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in sample:
                k += 1
            n, i = n + 1, i + k
        return n

    pick = random.Random(4)
    tries = [" " + " ".join("".join(pick.choice("abrncdq ") for _ in range(pick.randint(1, 20))).split()) + " " for _ in range(300)]
    tries = [t for t in tries if t.strip()]
    assert own.phrases([language_id.running(t) for t in tries])[0].tolist() == [phrases(t) for t in tries]
    docs = spark.createDataFrame([(1, None), (2, "123 ?"), (3, "abra " * 9000), (4, "q" * 5000), (5, ""), (6, "½ ① ²"), (7, "\u0301"), (7, "É")], DOCS)
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, own).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "x"), (4, "x"), (5, "und"), (6, "und"), (7, "und"), (7, "x")]
    assert language_id.predict(empty, language_id.train(empty.select(F.col("doc_id").alias("key"), "text", "lang"))).count() == 0


def test_null_and_large_ids_stay_exact(spark):
    big = (1 << 62) + 1
    docs = spark.createDataFrame([(None, "b"), (big, "a"), (big, "a"), (-5, None)], DOCS).coalesce(1)
    path = public_tokenizers.path("piece_bpe_32k.model")
    want = [None, -5, big, big]
    order = lambda rows: sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))
    assert order(sentencepiece_codec.encode_digests(docs, path).collect()) == want
    assert order(decontaminate.decontaminate(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect()) == want
    near = simhash.near_duplicates(docs).collect()
    assert order(near) == want and {r["component_id"] for r in near if r["doc_id"] == big} == {big}
    encode = token_files.tokenizer_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    files = token_files.read_files(token_files.write_files(docs, encode, 50_257, 0)).orderBy("start").collect()
    assert [r["doc_id"] for r in files] == want and [r["n_tokens"] for r in files] == [2, 1, 2, 2]
    assert order(language_id.predict(docs, language_id.Model({"x": " a b "})).collect()) == want
    pages = spark.createDataFrame([(None, "u", "x"), (big, "u", "x"), (7, "u", "y"), (None, "u", "z")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages)).collect())
    assert got == [(0, "response", None), (0, "revisit", big), (7, "response", None), (big, "response", None)]
