"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import byte_bpe, chat, exact_dedup, html_text, jaccard_join, line_crf, minhash, packing, passages, prefix_trie, spelling, url_filter, warc
from tillwise.llm.storage import read_table as table
from tillwise.llm.storage import stored

Query = Callable[[SparkSession, str], DataFrame]

SQL: dict[str, str] = {}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(pages))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op6_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


SQL["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
           WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
         END) AS shingle
  FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op9_warc"] = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), r AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
         array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(hex, (1 + 5 * i)::INT, 5))::INT >> (15 - 5 * j)::INT) & 31), 1)), '')), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM r
"""


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = F.lit("<|im_end|><|im_start|>assistant ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), control.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.formatted(chat.canonical_turns(rows)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


SQL["op10_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
             + length(regexp_replace(text, '(<\\*)\|', '\1\\|', 'g'))) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM c
"""


def _crc32(text: str) -> str:
    """DuckDB has no CRC-32: the bytes of ``text`` one after the other, each bit by bit."""
    code = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    step = "list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {code}), lambda c, b: {step}), 4294967295)"


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Runs that are too short already can't become long enough words.
    runs = spelling.occurrences(table(spark, sf_dir, "documents")).filter(F.length("run") >= 6)
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    runs = runs.withColumn("word", F.when(F.col("h") % 199 == 0, without).otherwise(F.col("run")))
    return spelling.variants(spelling.counted(runs, "word"))


SQL["op11_spelling_variants"] = rf"""
WITH r AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) WHERE length(run) >= 6 GROUP BY ALL
), h AS MATERIALIZED (SELECT run, k, {_crc32("doc_id || ':' || run")} AS h FROM r
), w AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
         sum(k)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5
), d AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.less = b.word
  UNION SELECT a.word, b.word, b.n FROM w a JOIN d b ON b.less = a.word
), f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.most >= 5 * w.n THEN m.near END AS form,
         CASE WHEN m.most >= 5 * w.n THEN m.most END AS form_n
  FROM w LEFT JOIN (SELECT word, count(*) AS n_near, max(n) AS most, first(near ORDER BY n DESC, encode(near)) AS near FROM near GROUP BY word) m USING (word)
), up AS (
  WITH RECURSIVE u AS (SELECT word, word AS root FROM f UNION ALL SELECT u.word, f.form FROM u JOIN f ON f.word = u.root AND f.form IS NOT NULL)
  SELECT u.word, u.root FROM u JOIN f ON f.word = u.root AND f.form IS NULL
)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up USING (word)
"""


def op12_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = stored(minhash.fingerprints(docs), "fingerprints")
    joined = found.join(minhash.near_copies(docs, found), "id", "left").withColumn("class_id", F.coalesce("class_id", "id")).withColumnRenamed("id", "doc_id")
    return joined.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.grafted(prefix_trie.paths(table(spark, sf_dir, "conversations")), 5, 9))


SQL["op13_conversation_trie"] = rf"""
WITH c AS MATERIALIZED (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
           ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), b AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(o.turns, [])[1:h], c.turns[h + 1:]) AS turns
  FROM (SELECT *, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM c) c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 5
), p AS MATERIALIZED (
  SELECT conv_id, d, turns[1:d] AS node, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM b)
), n AS MATERIALIZED (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(node[d].t)) END AS saved
  FROM p GROUP BY node, d
), k AS MATERIALIZED (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), s AS MATERIALIZED (
  SELECT n.node[1:a.d] AS node, a.d AS depth, sum(n.saved)::BIGINT AS saved_tokens,
         count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM n LEFT JOIN k ON k.node = n.node CROSS JOIN LATERAL (SELECT unnest(range(n.depth + 1)) AS d) a GROUP BY ALL
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens,
       n.ends_sha256
FROM n JOIN s ON s.node = n.node AND s.depth = n.depth LEFT JOIN k ON k.node = n.node
LEFT JOIN n up ON n.depth > 0 AND up.depth = n.depth - 1 AND up.node = n.node[1:n.depth - 1]
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filter, op2_exact_dedup, op3_html_text, op4_best_fit_packing, op5_repeated_passages, op6_line_labels, op7_byte_bpe, op8_ngram_jaccard_join, op9_warc, op10_chat_formatting, op11_spelling_variants, op12_minhash_fingerprints, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
