"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, chat, decontaminate, exact_dedup, extract, near_dedup, one_permutation, pitman_yor, prefix_trie, quality,
    structure, substrings, warc,
)
from .common import LOWER, UPPER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.from_turns(table(spark, sf_dir, "conversations")), chat.RESPOND)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=200, texts=False)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = one_permutation.edited_and_next(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op12_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = structure.damaged(table(spark, sf_dir, "conversations"))
    return structure.report(structure.edits(turns, absent="dropped"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.positions(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_bpe": op7_bpe,
    "op8_warc": op8_warc,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_conversation_structure_repair": op12_conversation_structure_repair,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
    "pipeline": pipeline,
}

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

#: The table of CRC-32, a row of one list, and the CRC-32 of an ASCII string by it.
CRC_TABLE = """codes AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"""


def crc32(text: str) -> str:
    letters = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    step = "lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {letters}), {step}), 4294967295::BIGINT)"


ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
                    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
        spots AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
                  FROM d, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) - size + 2)) AS u(i)),
        found AS (SELECT doc_id, i, s.size, item_id FROM spots s JOIN windows USING (size, gram)),
        hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, size)) AS u(k) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op9_chat_formatting": """
        WITH RECURSIVE t AS (
          SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
                 CASE role WHEN 'user' THEN 'call_' || conv_id || '_' || turn WHEN 'assistant' THEN 'call_' || conv_id || '_' || (turn - 1) END AS call_id
          FROM conversations),
        calls AS (SELECT conv_id, turn, call_id, count(*) AS n FROM t WHERE kind = 'call' GROUP BY ALL),
        depth AS (
          SELECT c.conv_id, c.turn, 0 AS level FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 WHERE p.turn IS NULL
          UNION ALL SELECT c.conv_id, c.turn, d.level + 1 FROM depth d JOIN calls c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2),
        known AS (SELECT c.*, level FROM calls c JOIN depth USING (conv_id, turn)),
        results AS (SELECT conv_id, call_id, count(*) AS n FROM t WHERE kind = 'result' GROUP BY ALL),
        wrong AS (
          SELECT t.*, k.n AS n_calls, k.level AS depth, r.n AS n_results,
                 list_sort(list_filter([CASE WHEN kind = 'call' AND k.n > 1 THEN 'duplicate id' END, CASE WHEN kind = 'call' AND text IS NULL THEN 'prompt: missing' END,
                              CASE WHEN kind = 'call' AND length(text) > 1500 THEN 'prompt: longer than 1500' END, CASE WHEN kind = 'call' AND t.turn < 0 THEN 'turn: less than 0' END], lambda x: x IS NOT NULL)) AS e
          FROM t LEFT JOIN known k ON k.conv_id = t.conv_id AND k.call_id = t.call_id LEFT JOIN results r ON r.conv_id = t.conv_id AND r.call_id = t.call_id)
        SELECT conv_id, turn, kind, call_id,
               CASE kind WHEN 'call' THEN coalesce(n_results, 0) > 0 WHEN 'result' THEN n_calls IS NOT NULL ELSE false END AS linked,
               CASE kind WHEN 'call' THEN depth * 2 WHEN 'result' THEN depth * 2 + 1 END::BIGINT AS level,
               len(e) = 0 AS valid, array_to_string(e, '; ') AS errors,
               CASE kind WHEN 'call' THEN '{"arguments":' || to_json({'prompt': text, 'turn': turn})::VARCHAR || ',"id":' || to_json(call_id)::VARCHAR || ',"name":"respond","type":"call"}'
                    WHEN 'result' THEN '{"content":' || to_json(text)::VARCHAR || ',"id":' || to_json(call_id)::VARCHAR || ',"type":"result"}'
                    ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || ',"type":"message"}' END AS json
        FROM wrong""",
    "op12_conversation_structure_repair": f"""
        WITH RECURSIVE {CRC_TABLE},
        t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS what FROM conversations, codes),
        d AS (SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role,
                     CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
              FROM t, unnest(range(0, CASE what WHEN 3 THEN 2 ELSE 1 END)) WHERE what <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                     rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stem FROM d),
        f AS (SELECT *, CASE WHEN stem = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(stem, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                     left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        moves(state, edit, needs, after, cost) AS (VALUES
          (0, 'D', NULL, 0, 3), (1, 'D', NULL, 1, 3), (2, 'D', NULL, 2, 3), (3, 'D', NULL, 3, 3),
          (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
          (0, 'R', NULL, 2, 2), (1, 'R', NULL, 2, 2), (2, 'R', NULL, 3, 2), (3, 'R', NULL, 2, 2)),
        adds(state, edits, after, cost, said) AS (VALUES
          (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''),
          (0, 'I', 2, 2, '|user:'), (1, 'I', 2, 2, '|user:'), (2, 'I', 3, 2, '|assistant:'), (3, 'I', 2, 2, '|user:'),
          (0, 'II', 3, 4, '|user:|assistant:'), (1, 'II', 3, 4, '|user:|assistant:'), (2, 'II', 2, 4, '|assistant:|user:'), (3, 'II', 3, 4, '|user:|assistant:')),
        walk AS (
          SELECT conv_id, 0::BIGINT AS i, after AS state, {{'cost': cost::BIGINT, 'audit': edits, 'said': replace(said, '|', chr(10))}} AS best
          FROM (SELECT DISTINCT conv_id FROM conversations), adds WHERE state = 0
          UNION ALL
          SELECT w.conv_id, f.i, n.after, min({{'cost': w.best.cost + m.cost + n.cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 1 ELSE 0 END,
                 'audit': w.best.audit || m.edit || n.edits,
                 'said': w.best.said || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
                         ELSE chr(10) || CASE m.after WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || text END || replace(n.said, '|', chr(10))}})
          FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
          JOIN moves m ON m.state = w.state AND (needs IS NULL OR needs = initial) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
          JOIN adds n ON n.state = m.after
          GROUP BY w.conv_id, f.i, n.after),
        facts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
                         count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
                         count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        paths AS (SELECT w.conv_id, min(best) AS best FROM walk w LEFT JOIN facts s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
                  WHERE w.i = coalesce(s.n, 0) AND state IN (0, 3) GROUP BY w.conv_id)
        SELECT p.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost AS cost, best.audit AS audit,
               sha256(substr(best.said, 2)) AS repaired_sha256
        FROM paths p LEFT JOIN facts s ON s.conv_id IS NOT DISTINCT FROM p.conv_id""",
    "op13_conversation_prefix_trie": f"""
        WITH {CRC_TABLE},
        own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''),
                       sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS p
                FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        heads AS (SELECT conv_id, p, {crc32("conv_id::VARCHAR")} % 9 AS h FROM own, codes),
        made AS (SELECT c.conv_id, list_concat(coalesce(b.p[1:h], []), c.p[h + 1:]) AS p FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
        member AS (SELECT conv_id, d, p[1:d] AS path, len(p) = d AS ends FROM made, unnest(range(0, len(p) + 1)) AS u(d)),
        node AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
                        (count(*) - 1) * coalesce(strlen(path[d].text), 0) AS saved FROM member GROUP BY path, d),
        child AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
        beneath AS (SELECT n.path[1:k] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
                    FROM node n LEFT JOIN child c ON c.path = n.path, unnest(range(0, depth + 1)) AS u(k) GROUP BY 1)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM node n LEFT JOIN child c ON c.path = n.path JOIN beneath b ON b.path = n.path LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]""",
}
