"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm.runtime import table


def op1_language_id(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    from cueflow.llm.language_id import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueflow.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueflow.llm.order_minhash import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueflow.llm.substring_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueflow.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    from cueflow.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueflow.llm.line_dedup import remove_boilerplate

    out = remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """The key is the argument, or that of the setting ``spark.cueflow.pii.secret``; without one each run has a key of its own."""
    import secrets

    from cueflow.llm.pii import KINDS, pseudonymise

    key = key or spark.conf.get("spark.cueflow.pii.secret", "").encode() or secrets.token_bytes(32)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key).select("doc_id", "text", *[f"n_{k}" for k in KINDS])


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueflow.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueflow.llm.sharding import sharded_documents

    return sharded_documents(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueflow.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueflow.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueflow.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_order_minhash, op4_substring_dedup, op5_quality_classifier, op6_byte_bpe, op7_line_dedup, op8_pii, op9_simhash_near_dedup, op10_sharding, op11_ranked_search, op12_prefix_trie, op13_mixing)}

ORACLE = {
    "op7_line_dedup": """
        WITH pieces AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        bad AS (SELECT trim(line, ' ') AS line, min(doc_id) AS keeper FROM pieces WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
        marked AS (SELECT p.doc_id, p.pos, p.line, b.line IS NOT NULL AS bad, b.keeper,
                          min(p.pos) OVER (PARTITION BY p.doc_id, b.line) AS first_pos
                   FROM pieces p LEFT JOIN bad b ON trim(p.line, ' ') = b.line),
        flagged AS (SELECT *, bad AND NOT (doc_id = keeper AND pos = first_pos) AS gone FROM marked)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM flagged GROUP BY doc_id""",
    "op11_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        k AS (SELECT count(*) AS n_docs, sum(len(words)) AS n_words FROM d WHERE len(words) > 0),
        i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        q AS (SELECT item_id, term, count(*) AS qf FROM i GROUP BY ALL),
        p AS (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d),
        f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, k GROUP BY term),
        x AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)) AS part FROM f, k),
        s AS (SELECT item_id, r, doc_id, CAST(sum(qf * w * part) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN x USING (term) GROUP BY ALL),
        o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20""",
    "op12_prefix_trie": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        l AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
        k AS (SELECT conv_id, n, conv_id - conv_id % 5 AS donor, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::UBIGINT)),
                lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, bit: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 9 AS BIGINT) AS h FROM l),
        r AS (SELECT k.conv_id, t.nth AS pos, role, text FROM k JOIN t ON t.conv_id = k.donor AND t.nth < k.h
              UNION ALL SELECT k.conv_id, least(k.h, coalesce(d.n, 0)) + t.nth - k.h, role, text FROM k JOIN t ON t.conv_id = k.conv_id LEFT JOIN l d ON d.conv_id = k.donor WHERE t.nth >= k.h),
        p AS (SELECT conv_id, pos + 1 AS depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS key, strlen(text) AS bytes FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM l),
        node AS (SELECT key, depth, min(conv_id) AS owner, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY key, depth),
        ends AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) AS back FROM p) WHERE back = 1 GROUP BY key),
        above AS (SELECT n.key, n.owner, n.depth, n.n_convs, n.bytes, p.key AS upper_key, p.depth AS lvl FROM node n JOIN p ON p.conv_id = n.owner AND p.depth <= n.depth),
        parent AS (SELECT a.key, m.owner AS up FROM above a JOIN node m ON m.key = a.upper_key WHERE a.lvl = a.depth - 1),
        inner_nodes AS (SELECT DISTINCT upper_key AS key FROM above WHERE lvl = depth - 1),
        total AS (SELECT upper_key AS key, count(*) FILTER (WHERE depth = lvl + 1) AS n_children, count(*) FILTER (WHERE key NOT IN (SELECT key FROM inner_nodes)) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM above GROUP BY upper_key)
        SELECT n.owner AS conv_id, CAST(n.depth AS BIGINT) AS depth, up AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM node n JOIN total USING (key) LEFT JOIN parent USING (key) LEFT JOIN ends USING (key)""",
}
