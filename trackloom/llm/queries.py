"""One query per corpus operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontamination, hamming, language, lm, merkle, minhash, packing, periods, pieces, pii, quality, substrings, warc
from trackloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


QUERIES["op10_warc"] = op10_warc

_BASE32 = " || ".join(
    f"substr('{warc.ALPHABET}', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::INT >> {s}) & 31), 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)
ORACLES["op10_warc"] = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), k AS (
  SELECT page_id, strlen(body) AS payload_bytes, {_BASE32} AS payload_digest,
         max(page_id) OVER (PARTITION BY body) AS keeper
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to,
       TRUE AS valid
FROM k"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and which items they come from."""
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op9_decontamination"] = op9_decontamination

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
#: Also the stage of the pipeline, over its own documents.
ORACLES["op9_decontamination"] = f"""
WITH item AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 13) AS n,
         unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS gram
  FROM item WHERE len(w) > 0
), doc AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), size AS (
  SELECT DISTINCT n FROM win
), pos AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n
), spot AS (
  SELECT pos.doc_id, pos.i, pos.n, array_to_string(w[pos.i:pos.i + pos.n - 1], ' ') AS gram FROM pos JOIN doc USING (doc_id)
), hit AS (
  SELECT DISTINCT spot.doc_id, spot.i, spot.n, win.item_id FROM spot JOIN win USING (n, gram)
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: pattern spans and those the random field adds."""
    return pii.report(table(spark, sf_dir, "documents"))


QUERIES["op8_pii"] = op8_pii


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document."""
    return language.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op7_language"] = op7_language
QUERIES["op5_quality"] = op5_quality


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document as pieces, and whether they decode to it."""
    return pieces.report(table(spark, sf_dir, "documents"))


QUERIES["op4_pieces"] = op4_pieces


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree code length of every whole document, with a word-count baseline."""
    return lm.score(table(spark, sf_dir, "documents"))


QUERIES["op3_context_tree"] = op3_context_tree


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.classes(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES["op2_near_duplicates"] = op2_near_duplicates


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that several documents share."""
    return substrings.passages(table(spark, sf_dir, "documents"))


def op6_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes for every vector whose id is divisible by 20."""
    return hamming.nearest(table(spark, sf_dir, "embeddings"))


QUERIES["op1_substrings"] = op1_substrings
QUERIES["op6_hamming"] = op6_hamming
ORACLES["op6_hamming"] = """
WITH c AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id,
         len(list_filter(range(1, 65), lambda i: q.s[i] <> c.s[i])) AS distance
  FROM c AS q, c WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM d
)
SELECT query_id, rank::INT AS rank, id, distance::INT AS distance FROM r WHERE rank <= 10"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words in every whole document, and the text without their repeats."""
    return periods.report(table(spark, sf_dir, "documents"))


QUERIES["op11_periodic_runs"] = op11_periodic_runs


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in sequences of 2048 tokens."""
    return packing.report(spark, table(spark, sf_dir, "documents"))


QUERIES["op12_packing"] = op12_packing


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root of its version."""
    return merkle.report(table(spark, sf_dir, "documents"))


QUERIES["op13_merkle"] = op13_merkle


def _leaf(*fields: str) -> str:
    texts = (f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields)
    return f"sha256({' || '.join(texts)})"


_KEY = "coalesce(doc_id::VARCHAR, '')"
_CRC = (
    f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, strlen({_KEY}) + 1), "
    f"lambda i: ascii(substr({_KEY}, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
)
ORACLES["op13_merkle"] = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), leaf AS (
  SELECT doc_id, lang, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS h,
         CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("doc_id", "source", "lang", "n_chars + 1", "text")} END AS changed
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM leaf
), node AS (
  SELECT 0 AS lvl, lang, pos, h, n FROM placed
  UNION ALL
  SELECT lvl + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM node WHERE n > 1 GROUP BY lvl, lang, pos // 2, n
), sub AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1
), top AS (
  SELECT 0 AS lvl, pos, h, n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n
), walk AS (
  SELECT doc_id, lang, h AS leaf, 0 AS lvl, pos, n, '' AS proof, coalesce(changed, h) AS folded FROM placed
  UNION ALL
  SELECT doc_id, w.lang, leaf, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || folded ELSE folded || coalesce(s.h, '') END)
  FROM walk w LEFT JOIN node s ON s.lvl = w.lvl AND s.lang IS NOT DISTINCT FROM w.lang AND s.pos = xor(w.pos, 1)
  WHERE w.n > 1
), climb AS (
  SELECT doc_id, leaf, s.h AS subroot, 0 AS lvl, s.pos, s.n, proof, folded
  FROM walk w JOIN sub s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || folded ELSE folded || coalesce(s.h, '') END)
  FROM climb w LEFT JOIN top s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1)
  WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = top.h AS verified
FROM climb, top WHERE climb.n = 1 AND top.n = 1"""
