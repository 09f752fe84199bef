"""The queries of the operators for training data, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecframe.llm import conversations, copies, leakage, neighbors, packing, pairs, sentences, topn
from vecframe.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: copies.p1_members(read_table(s, d, "cache_entries")),
        "p1_records": lambda s, d: copies.p1_records(read_table(s, d, "cache_entries")),
        "p2_found": lambda s, d: neighbors.p2_pairs(read_table(s, d, "advanced_docs")),
        "p2_neighbors": lambda s, d: neighbors.p2_neighbors(read_table(s, d, "advanced_docs")).selectExpr("id as adv_id", "posexplode(near) as (pos, hit)").selectExpr("adv_id", "pos + 1 as place", "hit.id as neighbor_id", "-hit.far as cosine"),
        "p3_found": lambda s, d: topn.p3_topn(read_table(s, d, "route_matches")).selectExpr("g as route_name", "id as match_id"),
        "p4_found": lambda s, d: conversations.p4_conversations(read_table(s, d, "history_messages")).selectExpr("session as session_id", "turn as turn_no", "id as message_id"),
        "p5_found": lambda s, d: pairs.p5_defects(read_table(s, d, "cache_hits"), read_table(s, d, "documents")).withColumnRenamed("id", "hit_id"),
        "p6_pack": lambda s, d: packing.p6_pack(read_table(s, d, "documents")).withColumnRenamed("id", "doc_id"),
        "p6_totals": lambda s, d: packing.p6_totals(read_table(s, d, "documents")),
        "p7_found": lambda s, d: leakage.p7_leaked(read_table(s, d, "documents"), read_table(s, d, "eval_items")).selectExpr("id as doc_id", "item as item_id"),
        "p8_found": lambda s, d: sentences.p8_units(read_table(s, d, "documents")).withColumnRenamed("id", "doc_id"),
    }


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _keys_sql() -> str:
    """(entry_id, prompt, key): the canonical key of each prompt; of a list of named fields its sorted ``name=value`` parts.

    A list is split at the first mark that gives two parts or more, each of them a name and a value; quotes hold marks.
    """
    field = r"""(?s)^\s*["'“‘]?\s*([\p{L}][\p{L}\p{N}_ .\-]{0,63}?)\s*["'”’]?\s*(?:[:=]|->|=>)\s*(.*?)\s*$"""
    around = r"^[\s>*•\-]+|[\s.]+$"
    bare = lambda x: rf"lower(upper(regexp_replace(nfc_normalize({x}), '[^\p{{L}}\p{{N}}\p{{M}}]|[\x{{FE00}}-\x{{FE0F}}\x{{20E3}}]', '', 'g')))"

    def parts(mark: str) -> str:
        piece = rf"""(?:"[^"]*"|[:=]\s*'[^']*'|[^"{mark}]|")+"""
        return rf"list_filter(list_transform(regexp_extract_all(t, {_text(piece)}), lambda x: regexp_replace(x, {_text(around)}, '', 'g')), lambda x: regexp_matches(x, '\S'))"

    marks = [";", "|", r"\n", ",", "&", r"\t"]
    splits = ", ".join(f"{parts(m)} AS m{i}" for i, m in enumerate(marks))
    whole = lambda m: f"len({m}) > 1 AND len(list_filter({m}, lambda x: NOT regexp_matches(x, {_text(field)}))) = 0"
    first = " ".join(f"WHEN {whole(f'm{i}')} THEN m{i}" for i in range(len(marks)))
    name, value = (bare(f"regexp_extract(x, {_text(field)}, {i})") for i in (1, 2))
    return rf"""
        SELECT entry_id, prompt, CASE WHEN fields IS NULL THEN {bare('prompt')} ELSE array_to_string(list_sort(list_transform(fields, lambda x: {name} || '=' || {value})), chr(10)) END AS key
        FROM (SELECT entry_id, prompt, CASE {first} END AS fields
        FROM (SELECT entry_id, prompt, {splits}
        FROM (SELECT entry_id, prompt, CASE WHEN starts_with(t, '{{') AND ends_with(t, '}}') THEN substr(t, 2, length(t) - 2) ELSE t END AS t
        FROM (SELECT entry_id, prompt, regexp_replace(prompt, {_text(around)}, '', 'g') AS t
        FROM (SELECT DISTINCT ON (entry_id) entry_id, prompt FROM cache_entries WHERE prompt IS NOT NULL)))))"""


def oracle_sql() -> dict[str, str]:
    keys = _keys_sql()
    return {
        "p1_found": f"SELECT first_id, entry_id FROM (SELECT entry_id, min(entry_id) OVER (PARTITION BY key) AS first_id FROM ({keys}) WHERE key <> '') WHERE first_id <> entry_id",
        "p1_records": f"SELECT min(entry_id) AS first_id, count(*) AS n_copies, arg_min(prompt, entry_id) AS prompt FROM ({keys}) WHERE key <> '' GROUP BY key",
        "p2_neighbors": """
            WITH v AS (SELECT DISTINCT ON (adv_id) adv_id, embedding::DOUBLE[384] e FROM advanced_docs
                       WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
                         AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            p AS (SELECT a.adv_id, b.adv_id AS neighbor_id, round(array_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.adv_id <> b.adv_id)
            SELECT adv_id, neighbor_id, cosine, (row_number() OVER (PARTITION BY adv_id ORDER BY cosine DESC, neighbor_id))::INTEGER AS place FROM p
            QUALIFY row_number() OVER (PARTITION BY adv_id ORDER BY cosine DESC, neighbor_id) <= 10""",
        "p6_totals": "SELECT count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS cut_short, 0::BIGINT AS broken, true AS compact FROM documents WHERE text IS NOT NULL",
        "p2_found": """
            WITH v AS (SELECT DISTINCT ON (adv_id) adv_id, embedding::DOUBLE[384] e FROM advanced_docs
                       WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
                         AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            r AS (SELECT a.adv_id a, b.adv_id b, row_number() OVER (PARTITION BY a.adv_id
                    ORDER BY round(array_cosine_similarity(a.e, b.e), 6) DESC, b.adv_id) r
                  FROM v a JOIN v b ON a.adv_id <> b.adv_id)
            SELECT DISTINCT least(a, b) AS adv_id_a, greatest(a, b) AS adv_id_b FROM r WHERE r <= 10""",
        "p3_found": r"""
            SELECT DISTINCT route_name, match_id FROM (
              SELECT route_name, match_id, dense_rank() OVER (PARTITION BY route_name ORDER BY distance, match_id) r
              FROM (SELECT regexp_replace(route_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') route_name, match_id, distance
                    FROM route_matches WHERE distance IS NOT NULL AND NOT isnan(distance))
              WHERE route_name <> '') WHERE r <= 5""",
        "p4_found": r"""
            WITH m AS (
              SELECT DISTINCT ON (message_id) message_id, seq_no,
                regexp_replace(session_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') sid,
                CASE lower(regexp_replace(speaker_role, '[\s\p{Z}]+', '', 'g'))
                  WHEN 'user' THEN 'u' WHEN 'human' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'bot' THEN 'a'
                  WHEN 'ai' THEN 'a' WHEN 'system' THEN 's' ELSE 'x' END role,
                coalesce(regexp_matches(content, '[^\s\p{Z}\p{Cc}\p{Cf}]'), false) shown,
                coalesce(make_timestamp(1000 * TRY_CAST(CASE WHEN regexp_full_match(sent_ms, '-?[0-9]+') THEN sent_ms END AS BIGINT)),
                         CAST(TRY_CAST(CASE WHEN sent_ms LIKE '%T%' THEN sent_ms END AS TIMESTAMPTZ) AS TIMESTAMP)) ts
              FROM history_messages ORDER BY message_id),
            k AS (
              SELECT sid FROM m GROUP BY sid HAVING bool_and(role <> 'x' AND shown AND ts IS NOT NULL)
                AND regexp_full_match(string_agg(role, '' ORDER BY ts, seq_no NULLS FIRST, message_id), 's*(ua)+'))
            SELECT sid AS session_id, row_number() OVER (PARTITION BY sid ORDER BY ts, seq_no NULLS FIRST, message_id) AS turn_no, message_id
            FROM m SEMI JOIN k USING (sid) WHERE sid <> ''""",
    }
