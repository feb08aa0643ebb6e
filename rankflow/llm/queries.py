"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontaminate, exact_dedup, language_id, lexical_search, line_dedup, pii, sentencepiece_codec, simhash, token_files, topk, toxicity, warc
from .common import fold, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_scorer(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Scorer:
    """Learns from labelled documents whose crc32(doc_id) modulo 3 is not 1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("doc_id is not null")
    labels = labels.where(fold("doc_id", 3) != 1)
    part = toxicity.hash_below(F.col("doc_id"), toxicity.sample_fraction(labels.count(), toxicity.SAMPLE_DOCS), 5)
    chosen = docs.select("doc_id", "text").where(part & (fold("doc_id", 3) != 1))
    return toxicity.train(chosen.join(labels.where(part), "doc_id").select(F.col("doc_id").alias("key"), "text", "toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity_scorer(spark, docs, sf_dir))
    return rows.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_passages")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = token_files.tokenizer_encoder(tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents"), encode, 50_257, 0))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, blocks=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.clean_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where((fold("doc_id", 4) >= 0) & (fold("doc_id", 4) != 2)).select(F.col("doc_id").alias("key"), "text", "lang")
    rows = language_id.predict(docs, language_id.train(known))
    return rows.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_sentencepiece, op3_token_files, op4_decontaminate, op5_pii, op6_line_dedup, op7_warc, op8_top_k, op9_language_id, op10_simhash, op11_lexical_search, op12_conversation_trie, op13_exact_dedup)
}

_WORDS_SQL = r"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op4_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL.format(c="text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_SQL.format(c="text")} AS w FROM benchmark),
win AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
keys AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS k FROM win),
pos AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM keys) WHERE len(w) >= n),
occ AS (SELECT DISTINCT doc_id, item_id, p.n, i FROM pos p JOIN keys q ON p.n = q.n AND list_slice(w, i, i + p.n - 1) = q.k),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, s.first IS NOT NULL AND doc_id > s.first AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM g""",
    "op8_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_lexical_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
m AS (SELECT doc_id, 100 - 75 + (75 * len(w) * s.n) // s.l AS m, w FROM d, s WHERE len(w) > 0),
tf AS (SELECT doc_id, m, t, count(*) AS tf FROM (SELECT doc_id, m, unnest(w) AS t FROM m) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(df.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN tf USING (t) JOIN df USING (t) GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op12_conversation_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id AS c, conv_id - conv_id % 100 AS b, list({'role': role, 'text': text} ORDER BY pos) AS v FROM t GROUP BY ALL),
h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda a, s: list_reduce(list_prepend(xor(a, s), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h FROM l),
w AS (SELECT h.c, list_concat(coalesce(b.v, [])[1:h.h], h.v[h.h + 1:]) AS v FROM h LEFT JOIN l b ON b.c = h.b),
r AS (SELECT c, unnest(range(0, len(v) + 1)) AS d, v FROM w),
p AS (SELECT c, d, v[1:d] AS p, d = len(v) AS last FROM r),
n AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(p[d].text) END AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY d, p),
a AS (SELECT p.c, d, n.conv_id AS node FROM p JOIN n USING (d, p)),
u AS (SELECT n.*, a.node AS parent_conv_id FROM n LEFT JOIN a ON a.c = n.conv_id AND a.d = n.d - 1),
k AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
s AS (SELECT a.node AS conv_id, a.d, count(*) FILTER (k.n_children IS NULL) AS n_leaves, CAST(sum(u.saved) AS BIGINT) AS saved_tokens FROM u LEFT JOIN k USING (conv_id, d) JOIN a ON a.c = u.conv_id AND a.d <= u.d GROUP BY ALL)
SELECT u.conv_id, u.d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM u LEFT JOIN k USING (conv_id, d) JOIN s USING (conv_id, d)""",
    "op13_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
}
