"""The registered queries of the operators in this folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import bpe, chat, fingerprints, lattice, line_dedup, mixing, packing, quality, repair, simhash, suffix, trie, warc
from labelmill.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(mixed, "doc.doc_id", "size", "source_size", "target", "taken")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.linked(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.planted(table(spark, sf_dir, "conversations"), -1, ("user", "assistant"), "</s>[INST] ok [/INST]")
    return chat.digests(chat.render(turns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(archive, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = bpe.codec()
    rows = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), by), by)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f for f in (
        op1_mixing, op2_chat, op3_simhash, op4_warc, op5_suffix, op6_quality, op7_lattice, op8_line_dedup, op9_packing, op10_fingerprints,
        op11_prefix_trie, op12_repair, op13_bpe)
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_CONTROL = r"[\[<]\\*(SYS\]|/SYS\]|INST\]|/INST\]|ROLE\]|/ROLE\]|s>|/s>)"
_FRAME_CHARS = {"system": len("[SYS]  [/SYS]"), "user": len("[INST]  [/INST]"), "assistant": len("<s> </s>")}

#: CRC-32 of the ASCII string ``s``, by a table that its rule makes.
_CRC_TABLE = """crc_table AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i)) AS t
        )"""
_CRC = """xor(list_reduce(list_transform(range(1, strlen(s) + 1), lambda i: ascii(s[i])::BIGINT),
                lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256]), 4294967295::BIGINT), 4294967295)"""

ORACLE: dict[str, str] = {
    "op11_prefix_trie": f"""
        WITH {_CRC_TABLE}, turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                   {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT c, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL), crc_table
        ), parts AS (
            SELECT c, 0 AS part, pos, said FROM convs JOIN turns ON conv_id = c - c % 5 AND pos <= h
            UNION ALL SELECT c, 1, pos, said FROM convs JOIN turns ON conv_id = c AND pos > h
        ), paths AS (
            SELECT c, coalesce(list(said ORDER BY part, pos) FILTER (said IS NOT NULL), []) AS path FROM convs LEFT JOIN parts USING (c) GROUP BY c
        ), prefixes AS (
            SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM paths
        ), nodes AS (
            SELECT path[1:d] AS p, d, min(c) AS least, count(*) AS n,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(path) = d), '')) AS ends_sha256
            FROM prefixes GROUP BY ALL
        ), kids AS (
            SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
        ), sums AS (
            SELECT nodes.p, d, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf,
                   CASE WHEN d = 0 THEN 0 ELSE (nodes.n - 1) * octet_length(encode(nodes.p[d].text)) END AS saved
            FROM nodes LEFT JOIN kids USING (p)
        ), below AS (
            SELECT p[1:k] AS p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM sums) GROUP BY 1
        )
        SELECT nodes.least AS conv_id, CAST(nodes.d AS INTEGER) AS depth, up.least AS parent_conv_id, nodes.n AS n_convs,
               coalesce(kids.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, nodes.ends_sha256
        FROM nodes JOIN below USING (p) LEFT JOIN kids USING (p) LEFT JOIN nodes AS up ON nodes.d > 0 AND up.p = nodes.p[1:nodes.d - 1]""",
    "op12_repair": f"""
        WITH RECURSIVE {_CRC_TABLE}, source AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations
        ), kinds AS (
            SELECT *, {_CRC} % 20 AS kind FROM source, crc_table
        ), damaged AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM kinds WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
                   rtrim(text, {_SPACES}) AS bare FROM damaged
        ), faults AS (
            SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
                   CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                        WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
        ), steps(state, word, after) AS (
            VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)
        ), filled AS (
            SELECT state, after, 0 AS n, '' AS letters, [] :: VARCHAR[] AS said FROM (SELECT state, state AS after FROM steps)
            UNION ALL SELECT state, after, 1, 'I', [word || ':'] FROM steps
            UNION ALL SELECT a.state, b.after, 2, 'II', [a.word || ':', b.word || ':'] FROM steps AS a JOIN steps AS b ON b.state = a.after
        ), best AS (
            SELECT conv_id, 0 :: BIGINT AS pos, 0 AS state, {{'cost': 0 :: BIGINT, 'audit': '', 'said': [] :: VARCHAR[]}} AS v FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, pos, state, min(v) FROM (
                SELECT b.conv_id, b.pos + 1 AS pos, e.to_state AS state, {{
                    'cost': b.v.cost + 5 * f.n + e.cost + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END,
                    'audit': b.v.audit || f.letters || e.edit,
                    'said': b.v.said || f.said || CASE e.edit WHEN 'D' THEN [] :: VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.word || ':' || r.text] END}} AS v
                FROM best AS b JOIN filled AS f ON f.state = b.state
                JOIN faults AS r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos + 1
                JOIN (
                    SELECT state, 'D' AS edit, 2 AS cost, state AS to_state, '' AS word, '' AS need FROM steps
                    UNION ALL SELECT state, 'R', 1, after, word, '' FROM steps
                    UNION ALL SELECT state, 'K', 0, after, word, word[1] FROM steps
                    UNION ALL VALUES (0, 'K', 0, 1, 'system', 's')
                ) AS e ON e.state = f.after AND (e.edit = 'D' OR r.fault IN ('', 'truncated') AND (e.edit = 'R' OR r.initial = e.need))
            ) GROUP BY conv_id, pos, state
        ), counts AS (
            SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(pos) AS n
            FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
        ), ended AS (
            SELECT b.conv_id, min({{'cost': b.v.cost + 5 * f.n, 'audit': b.v.audit || f.letters, 'said': b.v.said || f.said}}) AS v
            FROM best AS b JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.pos
            JOIN filled AS f ON f.state = b.state AND f.after IN (0, 3) GROUP BY b.conv_id
        )
        SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, e.v.cost AS cost, e.v.audit AS audit,
               sha256(array_to_string(e.v.said, chr(10))) AS repaired_sha256
        FROM counts AS c JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op2_chat": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), sized AS (
            SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + CASE role
                {" ".join(f"WHEN '{role}' THEN {n}" for role, n in _FRAME_CHARS.items())}
                ELSE {len("[ROLE]  [/ROLE] </s>")} + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS chars
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op4_warc": """
        WITH sized AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), best AS (
            SELECT payload, max(page_id) AS largest FROM sized WHERE octet_length(payload) >= 1000 GROUP BY payload
        )
        SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN largest <> page_id THEN largest END AS refers_to
        FROM sized LEFT JOIN best USING (payload)""",
    "op8_line_dedup": f"""
        WITH texts AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), parts AS (
            SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM texts
        ), keyed AS (
            SELECT *, translate(trim(line, {_SPACES}), {_LOWER}) AS key FROM parts
        ), frequent AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        ), marked AS (
            SELECT keyed.*, frequent.key IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
