"""Registered queries of the text operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import align, chat, decision, decontam, importance, jaccard, langid, neardup, packing, quality, sharding, substring, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """(tokenizer, ranks, pattern) of a public vocabulary on this machine; only its place is known here."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.dedup(table(spark, sf_dir, "embeddings"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recovered_chats(table(spark, sf_dir, "conversations"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), *align.public_sides())


QUERIES: dict[str, Query] = {
    "op1_language": op1_language,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard": op3_jaccard,
    "op4_decontamination": op4_decontamination,
    "op5_substring": op5_substring,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_neardup": op9_neardup,
    "op10_chat": op10_chat,
    "op11_importance": op11_importance,
    "op12_quality_rules": op12_quality_rules,
    "op13_alignment": op13_alignment,
}
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(x))), lambda k: ('0x' || substr(hex(encode(x)), 2 * k + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, steps.v[xor(c & 255, b) + 1]))"""
SQL: dict[str, str] = {
    "op11_importance": rf"""WITH steps AS (SELECT list(v ORDER BY i) AS v FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) AS t(i))),
      lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x, true AS own FROM documents
        UNION ALL SELECT NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), false FROM benchmark),
      split AS (SELECT doc_id, own, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
      tf AS (SELECT doc_id, own, w, count(*) AS n FROM (SELECT doc_id, own, unnest(ws) AS w FROM split) GROUP BY ALL),
      known AS (SELECT x, xor({_CRC32}, 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w AS x FROM tf) CROSS JOIN steps),
      held AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM tf JOIN known ON w = x GROUP BY 1),
      gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM held) + 10000) / ((s + 1) * ((SELECT sum(t) FROM held) + 10000))))::BIGINT AS g FROM held),
      weight AS (SELECT doc_id, sum(n * g)::BIGINT AS weight FROM tf JOIN known ON w = x JOIN gain USING (bucket) WHERE own GROUP BY 1),
      score AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM split LEFT JOIN weight USING (doc_id) WHERE own),
      placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM score)
      SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= (SELECT 10 * count(*) // 100 FROM score WHERE n_features >= 20) THEN r END AS rank FROM placed""",
    "op3_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
      p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0),
      s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle FROM p),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
      pairs AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
      links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
      reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
      low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
      SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.a = w.doc_id""",
    "op5_substring": f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
      p AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13),
      v AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS win FROM p),
      f AS (SELECT win, min(doc_id) AS first FROM v GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
      g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM v JOIN f USING (win) WHERE first < doc_id),
      t AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
      r AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.k) AS kept, count(*) AS n FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.k = t.k WHERE g.k IS NULL GROUP BY 1)
      SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(r.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id""",
}
