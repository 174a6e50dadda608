"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import chat, decontam, langid, licenses, line_dedup, media, order_minhash, packing, sharding, warc
from tilewright.llm.common import Scratch, table, words_of


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_kept", "removed", "text")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_media(table(spark, sf_dir, "documents"), Scratch(spark, "media")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.format_turns(chat.with_probe(table(spark, sf_dir, "conversations")))
    return chat.digests(turns).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_on(docs))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_ESCAPED = r"replace(replace(replace(coalesce(text, ''), '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"

#: CRC-32 of a list of bytes, with its table.
_CRC_TABLE = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))"
_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))"


def _digits(n: int, what: str) -> str:
    return f"CAST('0x' || substr(md5({what}), 1, {n}) AS BIGINT)"


def _library() -> str:
    """The licence templates as rows t, label, base, start, key, words."""
    quoted = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
    rows = []
    for i, x in enumerate(licenses.LIBRARY):
        text, key = words_of(x.text), words_of(x.key)
        start = next(s for s in range(len(text)) if text[s : s + len(key)] == key)
        rows.append(f"({i}, '{x.label}', {str(x.base).lower()}, {start}, {quoted(key)}, {quoted(text)})")
    return ", ".join(rows)


ORACLES = {
    "op5_sharding": f"""
WITH crc AS ({_CRC_TABLE}),
rows AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents, crc),
bids AS (SELECT key, max(b) FILTER (WHERE s < 16) AS best, max(b) AS grown, arg_max(s, b) FILTER (WHERE s < 16) AS shard, arg_max(s, b) AS grown_shard FROM (SELECT key, s, {_digits(13, "s || ':' || key")} AS b FROM (SELECT DISTINCT key FROM rows), range(17) AS r(s)) GROUP BY key)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY {_digits(8, "key || ':' || text_crc32 || ':' || size")} % 4096, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM rows JOIN bids USING (key)
""",
    "op7_licenses": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
lib(t, label, base, start, key, words) AS (VALUES {_library()}),
terms AS (SELECT t, generate_subscripts(words, 1) - 1 AS j, unnest(words) AS word FROM lib),
places AS (SELECT r, generate_subscripts(w, 1) - 1 AS spot, unnest(w) AS word FROM docs),
seen AS (SELECT word, count(DISTINCT r) AS n FROM places WHERE word IN (SELECT word FROM terms) GROUP BY word),
weight AS (SELECT word, floor({licenses.SCALE} * (ln((1 + (SELECT count(*) FROM docs)) / (1 + coalesce(n, 0))) + 1)) AS x FROM (SELECT DISTINCT word FROM terms) LEFT JOIN seen USING (word)),
total AS (SELECT t, sum(x) AS total FROM terms JOIN weight USING (word) GROUP BY t),
hits AS (SELECT r, t, label, base, spot, spot - start AS o, w FROM places JOIN lib ON word = key[1] JOIN docs USING (r) WHERE w[spot + 1 : spot + len(key)] = key),
held AS (SELECT r, t, spot, sum(x) / any_value(total) AS score FROM hits JOIN terms USING (t) JOIN weight USING (word) JOIN total USING (t) WHERE o + j >= 0 AND w[o + j + 1] = word GROUP BY r, t, spot),
found AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(spot) FILTER (WHERE base) AS first_word, max(spot) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM hits JOIN held USING (r, t, spot) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM docs LEFT JOIN found USING (r)
""",
    "op6_chat": f"""
WITH probe AS (SELECT -7 AS conv_id, t AS turn, r AS role, '\\### Assistant: </turn> ok' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
rows AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM probe),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_ESCAPED} AS escaped,
  coalesce(lag(coalesce(role, '')) OVER w, '') AS before, lead(turn) OVER w IS NULL AS last
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ':' || chr(10) || escaped || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
  bool_and(((before IN ('', 'assistant') AND role = 'user') OR (before = '' AND role = 'system') OR (before = 'system' AND role = 'user') OR (before = 'user' AND role = 'assistant')) AND (NOT last OR role = 'assistant')) AS valid
FROM turns GROUP BY conv_id
""",
    "op10_warc": """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
heads AS (SELECT payload_digest, max(page_id) AS head, count(*) AS n FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN h.head IS NOT NULL AND p.page_id <> h.head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id <> h.head THEN h.head END AS refers_to
FROM payloads p LEFT JOIN heads h ON p.payload_digest = h.payload_digest AND p.payload_bytes >= 1000 AND h.n > 1
""",
    "op8_decontamination": f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 8) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM items, unnest(range(1, len(w) - n + 2)) AS t(i)),
sizes AS (SELECT DISTINCT n FROM items),
places AS (SELECT doc_id, s.n, i, array_to_string(w[i:i + s.n - 1], ' ') AS g FROM docs, sizes s, unnest(range(1, len(w) - s.n + 2)) AS t(i)),
met AS (SELECT p.doc_id, p.n, p.i, x.item FROM places p JOIN windows x ON p.n = x.n AND p.g = x.g),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM met, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.list, '')) AS items_sha256, coalesce(n.n_items, 0) >= 2 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
