"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bitslice, ctw_running, decontaminate, language, licenses, line_dedup, packing, periodic, rotation, secrets, simhash, substrings, trie

#: Where the public tokenizers lie; a parameter of the machine, never part of the repository.
TOKENIZER_DIR = os.environ.get("RECORDLOOM_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZER_DIR}/{name}"
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_ctw_score(spark, sf_dir):
    return ctw_running.score(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_secrets(spark, sf_dir):
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op6_bitsliced_topk(spark, sf_dir):
    return bitslice.top_k(_table(spark, sf_dir, "embeddings"))


def op7_chat_rotation(spark, sf_dir):
    return rotation.rotate(_table(spark, sf_dir, "conversations"))


def op8_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op9_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(*trie.rebuilt(_table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return periodic.digests(periodic.collapse_runs(docs, periodic.planted(docs["doc_id"], docs["text"])))


def op13_license_templates(spark, sf_dir):
    return licenses.labelled(licenses.scan(_table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_ctw_score, op3_line_dedup, op4_decontaminate, op5_secrets, op6_bitsliced_topk, op7_chat_rotation, op8_language_id, op9_substring_dedup, op10_best_fit_packing, op11_prefix_trie, op12_periodic_runs, op13_license_templates)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
     h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY doc_id
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     v AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     p AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN (SELECT DISTINCT n FROM v) WHERE i + n - 1 <= len(w)),
     m AS (SELECT doc_id, i, p.n, item_id FROM p JOIN v USING (n, s)),
     h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP6 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     v AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
     f AS (SELECT s, min(doc_id) AS least FROM v GROUP BY s HAVING min(doc_id) < max(doc_id)),
     g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS x FROM v JOIN f USING (s) WHERE least < doc_id),
     k AS (SELECT doc_id, word, x FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS x FROM d))
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) r USING (doc_id)
       LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS kept FROM k ANTI JOIN g USING (doc_id, x) GROUP BY doc_id) t USING (doc_id)
"""


def oracle_sql() -> dict:
    return {"op3_line_dedup": OP3, "op4_decontaminate": OP4, "op6_bitsliced_topk": OP6, "op7_chat_rotation": rotation.ORACLE, "op9_substring_dedup": OP9, "op11_prefix_trie": trie.oracle(periodic.CRC.format("CAST(c AS VARCHAR)")), "op12_periodic_runs": periodic.ORACLE, "op13_license_templates": licenses.oracle()}
