"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cuckoo_dedup, decontam, embed_dedup, html_extract, impact_index, ngram_join, quality, sharding, token_align, token_output, warc
from .common import read


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def perturbed_vectors(embeddings: DataFrame) -> DataFrame:
    """Four vectors of double precision for each of `embeddings`, so that there are links: itself, two whose components vary by a rule of
    vec_id and place (cosines about 0.97 and 0.89 to itself), and one of another length in the same direction. Ids are 4 * vec_id + 0 to 3."""
    form = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("form")
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"), form)
    varied = F.expr("transform(e, (x, k) -> CASE form WHEN 3 THEN x * 2.0D ELSE x * (1.0D + 0.08D * form * (pmod(7 * vec_id + 13 * k + 29 * form, 11) - 5)) END)")
    return rows.select((4 * F.col("vec_id") + F.col("form")).alias("vec_id"), "label", varied.alias("embedding"))


def perturbed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 by its exact way over vectors of which many link."""
    return embed_dedup.near_duplicates(perturbed_vectors(read(spark, sf_dir, "embeddings")), target=1)


def op2_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op6_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"))


def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_of_documents(read(spark, sf_dir, "documents"))


def op10_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_and_read_back(read(spark, sf_dir, "conversations"))


def op11_cuckoo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op12_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_documents(read(spark, sf_dir, "documents"))


#: Components of the links (a, b), both ways; `ids` are all rows.
_COMPONENTS = """
reach(id, r) AS (SELECT id, id FROM ids UNION SELECT p.a, q.r FROM links p JOIN reach q ON p.b = q.id AND q.r < p.a),
least AS (SELECT id, min(r) AS r FROM reach GROUP BY id),
numbers AS (SELECT a, count(*) AS n FROM links GROUP BY a)
"""

_OP1 = f"""
WITH RECURSIVE given AS (%s),
ids AS (SELECT vec_id AS id FROM given),
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM given WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT *, sqrt(list_inner_product(e, e)) AS size FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND list_inner_product(p.e, q.e) / (p.size * q.size) >= 0.93),
{_COMPONENTS}
SELECT l.id AS vec_id, coalesce(n.n, 0) AS n_links, l.r AS component_id, l.id = l.r AS kept FROM least l LEFT JOIN numbers n ON n.a = l.id
"""

OP1_SQL = _OP1 % "SELECT vec_id, label, embedding FROM embeddings"

PERTURBED_SQL = _OP1 % """SELECT 4 * vec_id + form AS vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x, k:
  CASE form WHEN 3 THEN x * 2 ELSE x * (1::DOUBLE + 0.08::DOUBLE * form * ((7 * vec_id + 13 * (k - 1) + 29 * form) % 11 - 5)) END) AS embedding FROM embeddings, range(4) r(form)"""

OP8_SQL = f"""
WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
met AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM g p JOIN g q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE met.n * 10 >= (x.n + y.n - met.n) * 8),
{_COMPONENTS}
SELECT l.id AS doc_id, l.r AS class_id, coalesce(n.n, 0) AS n_links, l.id = l.r AS kept FROM least l LEFT JOIN numbers n ON n.a = l.id
"""

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id, payload_bytes >= 1000 AS big FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN big AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN big AND page_id <> last_id THEN last_id END AS refers_to FROM q
"""

#: The roles that the table holds; the marks' lengths are those of chat.MARKS.
OP10_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, len(regexp_extract_all(text, '\[INST\]|\[/INST\]|</?s>|<</?SYS>>|<<ROLE [^<>]*>>|<</ROLE>>')) AS controls, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 21 + len(url_encode(role)) END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(text) + controls + marks)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT h, arg_max(doc_id, row(chars, -doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN k USING (h)
"""

OP12_SQL = r"""
WITH t AS (SELECT rowid AS row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
p AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT row, sum(tf)::BIGINT AS n FROM p GROUP BY row),
g AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM s),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, nn),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY ALL),
r AS (SELECT item_id, q.text, doc_id, p.row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN s ON s.row = p.row, g GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_multi_index, perturbed_links, op2_shard_slots, op3_warc, op4_bradley_terry, op5_latent_leaks, op6_block_lstm, op7_byte_bpe, op8_lsh_forest, op9_simple8b, op10_chat_grammar, op11_cuckoo_filter, op12_bit_sliced, op13_segment_alignment)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_multi_index": OP1_SQL, "perturbed_links": PERTURBED_SQL, "op3_warc": OP3_SQL, "op10_chat_grammar": OP10_SQL, "op8_lsh_forest": OP8_SQL, "op11_cuckoo_filter": OP11_SQL, "op12_bit_sliced": OP12_SQL}
