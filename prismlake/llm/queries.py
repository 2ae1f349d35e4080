"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import alignment, chat, decontaminate, language, line_quality, neardup, packing, phrases, pii, quality_rules, substring, url_filter, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
OTHER_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and test item of which the document has 0.8 or more."""
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return quality_rules.score_documents(documents, quality_rules.fit(documents, _read(spark, sf_dir, "labels")))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_read(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), TOKENIZER)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return pii.find(documents, pii.fit(documents))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold the template's own marks."""
    said = "<|im_end|><|im_start|>assistant ok"
    marked = spark.sql("select -1L as conv_id, 0L as turn, 'user' as role, :said as text union all select -1L, 1L, 'assistant', :said", {"said": said})
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(marked)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages"))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return line_quality.score_documents(documents, line_quality.fit(documents, _read(spark, sf_dir, "labels")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"), TOKENIZER, OTHER_TOKENIZER)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language."""
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.digests(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_quality_rules, op3_repeated_passages, op4_minhash_dedup, op5_best_fit_packing, op6_personal_data, op7_url_rules, op8_chat_format, op9_language, op10_line_quality, op11_alignment, op12_phrases, op13_warc)}


#: Items of fewer than five words (none in the tables) would need their own width here.
_OP1 = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D\x20]+'), lambda x: x <> '') FROM benchmark
), s AS (
  SELECT DISTINCT side, id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT side, id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), sizes AS (SELECT id AS item_id, count(*) AS size FROM s WHERE side = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared
  FROM s d JOIN s i ON d.shingle = i.shingle AND d.side = 'd' AND i.side = 'i' GROUP BY d.id, i.id
)
SELECT doc_id, item_id, shared, size, shared / size AS containment
FROM shared JOIN sizes USING (item_id) WHERE shared >= 0.8 * size - 1e-9
"""

_OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(words)
), f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND c >= 10),
cut AS (SELECT lang, phrase, a, words, k, unnest(range(1, k)) AS j FROM c),
s AS (
  SELECT cut.lang, cut.phrase, a, j, x.c AS l, y.c AS r, (CAST(a AS HUGEINT) * a * 1000000) // (CAST(x.c AS HUGEINT) * y.c) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(words[1 : j], ' ')
           JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(words[j + 1 : cut.k], ' ')
), worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, array_to_string(words[1 : 2], ' ') AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(words[2 : 3], ' '), a FROM c WHERE k = 3
  ) GROUP BY lang, phrase
), kept AS (
  SELECT worst.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM worst LEFT JOIN inside USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""

_OP13 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_OP8 = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), r AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last_role,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS escaped
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + CASE WHEN last_role IS NULL OR last_role <> role THEN 24 + length(role) ELSE 11 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others fit models, search by hashes or tokenise."""
    return {"op1_decontamination": _OP1, "op8_chat_format": _OP8, "op12_phrases": _OP12, "op13_warc": _OP13}
