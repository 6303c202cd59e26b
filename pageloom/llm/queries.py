"""Named queries of the text-corpus operators over a data folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pageloom.llm.chat import chat_roles
from pageloom.llm.cube import mixed
from pageloom.llm.eliasfano import token_digests
from pageloom.llm.hnsw import near_vectors
from pageloom.llm.language import languages
from pageloom.llm.licenses import license_families
from pageloom.llm.minhash import near_duplicates
from pageloom.llm.phrases import collocations
from pageloom.llm.quality import qualities
from pageloom.llm.secrets import secrets
from pageloom.llm.toxicity import severities
from pageloom.llm.whitening import whitened
from pageloom.llm.wumanber import contamination
from pageloom.plans.catalog import Catalog, table

llm = Catalog()


@llm.query("op5_word_first_language")
def word_first_language(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"))


@llm.query("op6_oph_near_duplicates", """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), items AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM items
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT a AS id, a AS r FROM links UNION SELECT id, b FROM reach JOIN links ON r = a
), roots AS (
  SELECT id, min(r) AS root FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots ON id = d.doc_id
""")
def oph_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


WORDS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


@llm.query("op10_wu_manber_hits", f"""
WITH items AS (
  SELECT item_id, {WORDS_SQL} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), words AS (
  SELECT doc_id, {WORDS_SQL} AS w FROM documents
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows))
), found AS (
  SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, s)
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
""")
def wu_manber_hits(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, folder, "benchmark")).drop("text")


@llm.query("op3_elias_fano_ids")
def elias_fano_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@llm.query("op8_cube_mix")
def cube_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents"))


@llm.query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


@llm.query("op7_entropy_secrets")
def entropy_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets(table(spark, folder, "documents"))


@llm.query("op4_ordinal_toxicity")
def ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return severities(table(spark, folder, "documents"), table(spark, folder, "labels"))


@llm.query("op9_license_families")
def license_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return license_families(table(spark, folder, "documents"))


@llm.query("op1_chat_roles")
def chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat_roles(table(spark, folder, "conversations"))


@llm.query("op2_hnsw_links", """
WITH RECURSIVE links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id
  AND list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.9
), reach AS (
  SELECT a AS id, a AS r FROM links UNION SELECT id, b FROM reach JOIN links ON r = a
), roots AS (
  SELECT id, min(r) AS root FROM reach GROUP BY id
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN roots ON id = vec_id
""")
def hnsw_links(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@llm.query("op11_whitened_embeddings")
def whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings"))


@llm.query("op12_neighbour_quality")
def neighbour_quality(spark: SparkSession, folder: str) -> DataFrame:
    return qualities(table(spark, folder, "documents"), table(spark, folder, "labels"))


@llm.query("op13_toivonen_phrases", """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), places AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS t(k) WHERE len(w) >= k
), found AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100
), split AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM found WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS p, array_to_string(w[c + 1:k], ' ') AS q
  FROM (SELECT *, unnest(range(1, k)) AS c FROM split)
), scores AS (
  SELECT c.*, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = p JOIN found y ON y.lang = c.lang AND y.phrase = q JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), parts AS (
  SELECT lang, a AS f, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase FROM split WHERE k > 2
), held AS (
  SELECT lang, phrase, max(f) AS f FROM parts GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
WHERE coalesce(100 * h.f < 100 * a, true) QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000
""")
def toivonen_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
