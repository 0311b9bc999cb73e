"""Registered queries of the operators, over the whole given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, html_blocks, line_dedup, ngram_join, quality_rules, ranked_search, suffix_dedup, token_counts, turn_repair, warc, weak_quality
from .common import scratch

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = token_counts.count_tokens(sized, public_tokenizers.path(PIECE_MODEL))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    judged = quality_rules.judge(docs, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    vocabulary = public_tokenizers.path(WORD_VOCABULARY)
    coded = bpe.encode_and_decode(docs, vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.mark(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    path = scratch(spark, "warc")
    warc.write_archives(warc.page_records(pages), path)
    responses = warc.read_archives(spark, path).filter("record_type = 'response'").withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    revisits = warc.read_archives(spark, path, payload=False).filter("record_type = 'revisit'").withColumn("n", F.col("payload_length")).withColumn("digest", F.substring_index("payload_digest", ":", -1))
    page_of = lambda c: F.regexp_extract(c, r"page:(-?\d+)", 1).try_cast("long")
    return responses.unionByName(revisits).select(
        page_of("record_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to")
    )


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return weak_quality.judge(docs, weak_quality.fit(docs, labels)).select("doc_id", "score", "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    text = "<|im_end|><|im_start|>assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    chats = chat.conversations(rows.unionByName(planted))
    back = chat.read_back(chat.format_chats(chats, public_tokenizers.path(BYTE_VOCABULARY)))
    turns = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_join.join(table(spark, sf_dir, "documents", "doc_id", "text"))
    return members.select("doc_id", "n_shingles", "component_id")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_blocks.extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return turn_repair.repair(turn_repair.damaged(rows))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return ranked_search.search(docs, items)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_weak_quality": op4_weak_quality,
    "op5_chat_format": op5_chat_format,
    "op6_ngram_join": op6_ngram_join,
    "op7_main_text": op7_main_text,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_turn_repair": op11_turn_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
        ), i AS (
            SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
        ), w AS (
            SELECT item_id, least(len(words), 13) AS k, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS s, words FROM i WHERE len(words) > 0
        ), windows AS (
            SELECT DISTINCT item_id, k, array_to_string(words[s : s + k - 1], ' ') AS phrase FROM w
        ), lengths AS (
            SELECT DISTINCT k FROM windows
        ), p AS (
            SELECT doc_id, k, unnest(range(1, len(words) - k + 2)) AS s, words FROM d, lengths WHERE len(words) >= k
        ), m AS (
            SELECT doc_id, p.s, p.k, item_id FROM p JOIN windows ON windows.k = p.k AND phrase = array_to_string(words[p.s : p.s + p.k - 1], ' ')
        ), hit AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM m) GROUP BY 1
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY 1
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op3_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op5_chat_format": r"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), c AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                   sum(length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
                       + length('<|im_start|><|im_sep|><|im_end|>') + 1) AS formatted_chars
            FROM r GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               formatted_chars::BIGINT AS formatted_chars FROM c
    """,
    # `insert` has the ways of 0, 1 or 2 inserted turns between the states start, s, u, a of the grammar.
    "op11_turn_repair": r"""
        WITH RECURSIVE raw AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations
        ), hashed AS (
            SELECT conv_id, turn, role, text,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(k) + 1), lambda i: ('0x' || hex(k[i : i]))::BIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))),
                       4294967295) % 20 AS kind
            FROM raw
        ), hit AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   rtrim(text, e' \t\n\x0b\x0c\r') AS bare FROM hit
        ), t AS (
            SELECT conv_id, turn, role, text, n, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS r0,
                   CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM placed
        ), ids AS (
            SELECT DISTINCT conv_id FROM conversations
        ), facts AS (
            SELECT conv_id, max(n) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (r0 IS NOT NULL AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal
            FROM t GROUP BY conv_id
        ), ins(p, q, cost, audit, lines) AS (
            VALUES ('0', '0', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
                   ('0', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('a', 'u', 3, 'I', ['user:']), ('u', 'a', 3, 'I', ['assistant:']),
                   ('0', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:'])
        ), move(p, q, name) AS (
            VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')
        ), edits AS (
            SELECT conv_id, n, p, q, step, add_cost, line FROM t, (
                SELECT s.p, s.p AS q, 'D' AS step, NULL AS name FROM (VALUES ('0'), ('s'), ('u'), ('a')) s(p)
                UNION ALL SELECT p, q, 'K', name FROM move UNION ALL SELECT p, q, 'R', name FROM move WHERE name <> 's'
            ), LATERAL (
                SELECT CASE step WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN fault = 'truncated' AND step <> 'D' THEN 3 ELSE 0 END AS add_cost,
                       CASE step WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE name WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END AS line
            ) WHERE step = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (step = 'R' OR name = r))
        ), fold AS (
            SELECT conv_id, 0::BIGINT AS n, '0' AS p, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM ids
            UNION ALL
            SELECT f.conv_id, f.n + 1, e.q, (min({'c': f.cost + i.cost + e.add_cost, 'a': f.audit || i.audit || e.step})).c,
                   (min({'c': f.cost + i.cost + e.add_cost, 'a': f.audit || i.audit || e.step})).a,
                   arg_min(f.lines || i.lines || e.line, {'c': f.cost + i.cost + e.add_cost, 'a': f.audit || i.audit || e.step})
            FROM fold f JOIN ins i ON i.p = f.p JOIN edits e ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.n = f.n + 1 AND e.p = i.q
            GROUP BY f.conv_id, f.n, e.q
        ), ended AS (
            SELECT f.conv_id, min({'c': f.cost + i.cost, 'a': f.audit || i.audit}) AS v,
                   arg_min(f.lines || i.lines, {'c': f.cost + i.cost, 'a': f.audit || i.audit}) AS lines
            FROM fold f JOIN ins i ON i.p = f.p AND i.q IN ('0', 'a') LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM f.conv_id
            WHERE f.n = coalesce(n_rows, 0) GROUP BY f.conv_id
        )
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, v.c::BIGINT AS cost, v.a AS audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
        FROM ended e LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
    "op12_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
        ), k AS (
            SELECT *, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), shared AS (
            SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), m AS (
            SELECT doc_id, pos, line, first_id IS NOT NULL AND first_id <> doc_id AS gone FROM k LEFT JOIN shared USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op13_ranked_search": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS terms FROM documents
        ), i AS (
            SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term FROM benchmark
        ), s AS (
            SELECT count(*) FILTER (len(terms) > 0) AS n_all, sum(len(terms))::BIGINT AS l_all FROM d
        ), tf AS (
            SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
        ), w AS (
            SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, n_all
        ), scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_all) // l_all)))))::BIGINT AS score
            FROM i JOIN tf USING (term) JOIN w USING (term), s GROUP BY 1, 2 HAVING score > 0
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored QUALIFY rank <= 50
    """,
}
