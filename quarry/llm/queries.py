"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import embeddings, fingerprints, html_text, mixing, orc_tokens, phrases, sentencepiece_bridge, simhash, suffix_repeats, toxicity


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = c.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, c.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(c.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards", "places", "quotas")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(c.table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = phrases.remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(c.table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(c.table(spark, sf_dir, "embeddings"))


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{c.shared_folder(spark)}/tokens"
    orc_tokens.write_tokens(c.table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), path)
    return orc_tokens.digests(orc_tokens.read_tokens(spark, path))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bridge.digests(c.table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_repeats.remove_repeats(c.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, i, list_aggregate(w[i:i + 34], 'string_agg', ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
     rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
     gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN rep USING (s), unnest(range(0, 35)) AS u(k)),
     marked AS (SELECT d.doc_id, list(pos) AS g FROM d JOIN gone USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(coalesce(list_aggregate(list_filter(w, lambda x, i: g IS NULL OR NOT list_contains(g, i)), 'string_agg', ' '), '')) AS kept_sha256
FROM d LEFT JOIN marked USING (doc_id)
"""


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
     good AS (SELECT * FROM v WHERE NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true) AND list_contains(list_transform(e, lambda x: x <> 0), true)),
     link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
     reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT link.a, reach.c FROM reach JOIN link ON reach.vec_id = link.b),
     comp AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id),
     n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5_SQL, "op7_embedding_dedup": OP7_SQL}
