"""The queries of these operators, and the same in SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, html_text, infill, ngram_join, pieces, pii, quality, simhash, substrings, token_counts, topk, warc
from .common import bounded_batches

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_PIECES = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), PIECES)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.lines_of_documents(table(spark, sf_dir, "documents"), BYTE_PIECES)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(table(spark, sf_dir, "conversations"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_substrings": op4_substrings,
    "op5_topk": op5_topk,
    "op6_decontaminate": op6_decontaminate,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_html_text": op9_html_text,
    "op10_simhash": op10_simhash,
    "op11_conversations": op11_conversations,
    "op12_infill": op12_infill,
    "op13_ngram_join": op13_ngram_join,
}
SQL: dict[str, str] = {
    "op4_substrings": r"""
        WITH own AS (
            SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT uid, i, hash(array_to_string(w[i : i + 34], ' ')) AS h1, md5_number_lower(array_to_string(w[i : i + 34], ' ')) AS h2
            FROM (SELECT uid, w, unnest(range(1, len(w) - 33)) AS i FROM own)
        ), again AS (
            SELECT uid, i FROM windows WHERE (h1, h2) IN (SELECT (h1, h2) FROM windows GROUP BY h1, h2 HAVING count(*) > 1)
        ), gone AS (
            SELECT DISTINCT uid, unnest(range(i, i + 35)) AS i FROM again
        ), kept AS (
            SELECT o.uid, string_agg(o.word, ' ' ORDER BY o.i) AS text, count(*) AS n
            FROM (SELECT uid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM own) o ANTI JOIN gone g ON o.uid = g.uid AND o.i = g.i
            GROUP BY o.uid
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM own LEFT JOIN kept k USING (uid)
    """,
    "op8_warc": """
        WITH own AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), ranked AS (
            SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM own
        )
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda c:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + ((('0x' || substr(hex, 1 + 5 * g, 5))::INTEGER >> (15 - 5 * c)::INTEGER) & 31), 1)), 'string_agg', '')), 'string_agg', '')
                AS payload_digest,
            CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN last <> page_id THEN last END AS refers_to
        FROM ranked
    """,
    "op5_topk": """
        WITH own AS (
            SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM own q JOIN own c ON q.uid <> c.uid AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS n FROM scored
        )
        SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= 5
    """,
    "op11_conversations": r"""
        WITH RECURSIVE crcs AS (
            SELECT k, list_reduce(list_transform(list_prepend('', string_split(k, '')), lambda c: CASE WHEN c = '' THEN 4294967295::BIGINT ELSE ascii(c)::BIGINT END),
                lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                    lambda r, z: CASE WHEN (r & 1) = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc
            FROM (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)
        ), faulty AS (
            SELECT conv_id, turn, xor(crc, 4294967295) % 20 AS kind, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
            FROM conversations JOIN crcs ON k = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM faulty, range(2) AS copies(copy)
            WHERE kind <> 0 AND (copy = 0 OR kind = 3)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
                rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS initial
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)
        ), told AS (
            SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM placed
        ), counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM told GROUP BY conv_id
        ), inserted(q, to_q, letters, added, w) AS (
            VALUES (0, 0, '', '', 0), (0, 2, 'I', chr(10) || 'user:', 2), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 4),
                (1, 1, '', '', 0), (1, 2, 'I', chr(10) || 'user:', 2), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 4),
                (2, 2, '', '', 0), (2, 3, 'I', chr(10) || 'assistant:', 2), (3, 3, '', '', 0), (3, 2, 'I', chr(10) || 'user:', 2)
        ), edits(q, letter, initial, to_q, w) AS (
            VALUES (0, 'D', NULL, 0, 3), (1, 'D', NULL, 1, 3), (2, 'D', NULL, 2, 3), (3, 'D', NULL, 3, 3), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0),
                (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (0, 'R', NULL, 2, 2), (1, 'R', NULL, 2, 2), (2, 'R', NULL, 3, 2), (3, 'R', NULL, 2, 2)
        ), ways AS (
            SELECT conv_id, 0 AS i, 0 AS q, {'cost': 0, 'audit': '', 'out': ''} AS best FROM counted
            UNION ALL
            SELECT conv_id, i, q, best FROM (
                SELECT w.conv_id, t.i::INTEGER AS i, e.to_q AS q, min({
                    'cost': w.best.cost + s.w + e.w + CASE WHEN e.letter <> 'D' AND t.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': w.best.audit || s.letters || e.letter,
                    'out': w.best.out || s.added || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || t.role || ':' || t.text
                        ELSE chr(10) || CASE e.to_q WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || t.text END}) AS best
                FROM ways w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
                JOIN inserted s ON s.q = w.q
                JOIN edits e ON e.q = s.to_q AND (e.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR e.initial = t.initial)
                GROUP BY w.conv_id, t.i, e.to_q)
        ), done AS (
            SELECT w.conv_id, min({'cost': w.best.cost + s.w, 'audit': w.best.audit || s.letters, 'out': w.best.out || s.added}) AS best
            FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserted s ON s.q = w.q AND s.to_q IN (0, 3)
            GROUP BY w.conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.out, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
    "op12_infill": r"""
        WITH own AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex
            FROM documents
        ), h AS (
            SELECT *, len(u) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2, ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4
            FROM own
        ), cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ), parts AS (
            SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM cut
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parts
    """,
    "op13_ngram_join": r"""
        WITH RECURSIVE own AS (
            SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT uid, hash(s) AS h1, md5_number_lower(s) AS h2
            FROM (SELECT uid, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM own WHERE len(w) > 0)
        ), sizes AS (
            SELECT uid, count(*) AS n FROM shingles GROUP BY uid
        ), links AS (
            SELECT a.uid AS x, b.uid AS y
            FROM shingles a JOIN shingles b ON a.h1 = b.h1 AND a.h2 = b.h2 AND a.uid < b.uid JOIN sizes p ON p.uid = a.uid JOIN sizes q ON q.uid = b.uid
            GROUP BY a.uid, b.uid, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
        ), edges AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reached AS (
            SELECT uid, uid AS other FROM own UNION SELECT r.uid, b.y FROM reached r JOIN edges b ON b.x = r.other
        ), named AS (
            SELECT r.uid, min(o.doc_id) AS component_id FROM reached r JOIN own o ON o.uid = r.other GROUP BY r.uid
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM own LEFT JOIN sizes USING (uid) JOIN named USING (uid)
    """,
}
