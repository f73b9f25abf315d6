"""Queries of this folder, by name, with SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import html_extraction, mixing, quality_classifier, quality_rules, toxicity
from wardline.llm.alignment import align_tokenizers
from wardline.llm.common import read, small_batches
from wardline.llm.embedding_dedup import near_vectors
from wardline.llm.importance import resample
from wardline.llm.jaccard_join import jaccard_join
from wardline.llm.packing import pack_documents
from wardline.llm.positional_index import contamination
from wardline.llm.substring_dedup import remove_repeats
from wardline.llm.token_counts import count_tokens
from wardline.session import scratch_dir

QUERIES = {"pipeline": corpus_pipeline.run}
ORACLES = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}


def query(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


@query("op1_quality_classifier")
def op1(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.score_quality(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query("op3_quality_rules")
def op3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, read(spark, sf_dir, "labels")))


@query("op4_mixing")
def op4(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.language_model(docs, read(spark, sf_dir, "labels")), mixing.MIXTURE, highest=mixing.HIGHEST)
    shares = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(sorted(mixing.MIXTURE))]
    return mixed.select("doc_id", "tokens", *shares, "rate", "copies")


@query("op5_html_extraction")
def op5(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return html_extraction.extract_text(pages, html_extraction.train(pages))


_TEXT = "coalesce(text, '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


@query("op6_substring_dedup", f"""
WITH w AS (SELECT doc_id, {words_sql(_TEXT)} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM g),
m AS (SELECT k, min(doc_id) AS low FROM h GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h JOIN m USING (k) WHERE low < doc_id),
kept AS (
  SELECT x.doc_id, x.word, x.p FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p WHERE gone.p IS NULL),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM kept GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) AS BIGINT) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)
""")
def op6(spark, sf_dir):
    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_embedding_dedup")
def op7(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.95)


@query("op8_jaccard_join", f"""
WITH RECURSIVE w AS (SELECT doc_id, {words_sql(_LOWER)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
""")
def op8(spark, sf_dir):
    return jaccard_join(read(spark, sf_dir, "documents"), percent=90, n=3)


@query("op9_token_counts")
def op9(spark, sf_dir):
    # A cache of its own for each run: the figures are those of a cold cache.
    cache = f"{scratch_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


@query("op10_packing")
def op10(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("copy")


def letters_sql(text: str) -> str:
    """Words of ASCII letters, digits and what lies outside ASCII."""
    return f"regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


# CRC-32 byte by byte, through the table that its polynomial gives.
_CRC_TABLE = """tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(g))), lambda k: ('0x' || substr(hex(encode(g)), 2 * k + 1, 2))::BIGINT)),
  lambda v, b: xor(t[(xor(v, b) & 255) + 1], v >> 8)), 4294967295)"""


def _features_sql(table: str, key: str) -> str:
    words = f"SELECT {key} AS k, {letters_sql(_LOWER)} AS ws FROM {table}"
    return f"SELECT k, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM ({words})"


@query("op11_importance", f"""
WITH {_CRC_TABLE},
f AS ({_features_sql("documents", "doc_id")}), q AS ({_features_sql("benchmark", "item_id")}),
b AS (SELECT g, CAST({_CRC} % 10000 AS BIGINT) AS b FROM (SELECT DISTINCT g FROM (SELECT g FROM f UNION ALL SELECT g FROM q)), tab),
s AS (SELECT b, count(*) AS n FROM f JOIN b USING (g) GROUP BY b), t AS (SELECT b, count(*) AS n FROM q JOIN b USING (g) GROUP BY b),
a AS (SELECT (SELECT count(*) FROM f) AS s_all, (SELECT count(*) FROM q) AS t_all),
gain AS (SELECT s.b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((s.n + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS v FROM s LEFT JOIN t USING (b), a),
w AS (SELECT k, count(*) AS n, CAST(floor(sum(v) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (g) JOIN gain USING (b) GROUP BY k),
d AS (SELECT doc_id, len({letters_sql(_LOWER)}) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST(('0x' || substr(sha256('7:' || doc_id), 1, 8)) AS BIGINT) AS h FROM documents LEFT JOIN w ON k = doc_id),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM e WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM e LEFT JOIN r USING (doc_id)
""")
def op11(spark, sf_dir):
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op12_decontamination", f"""
WITH d AS (SELECT doc_id, {letters_sql(_LOWER)} AS ws FROM documents), q AS (SELECT item_id, {letters_sql(_LOWER)} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS k, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM q WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM g JOIN w USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def op12(spark, sf_dir):
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op13_alignment")
def op13(spark, sf_dir):
    small_batches(spark)
    return align_tokenizers(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
