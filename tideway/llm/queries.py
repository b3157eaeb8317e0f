"""The queries op1 to op13 over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, minhash, pii, prefix_trie, quality_model, quality_rules, substring_dedup, token_counts, toxicity, url_filter, vector_codes
from .frames import table
from .labelled import fold


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), length=35, with_text=False)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)
    return found.select("kept.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic")
    found = toxicity.score(docs, model).select("kept.doc_id", "score")
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), percent=85, shingle=5)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), "quality")
    found = quality_model.score(docs, model).select("kept.doc_id", "score")
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text")), "v2")
    return book.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = bpe.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return found.withColumnRenamed("id", "doc_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), window=13)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_conversations(rows).select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # what the loss mask covers in the output
    loss = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), parts=4, entries=256, rounds=4)
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")), family=100, heads=6)
    return prefix_trie.trie(convs).select(*prefix_trie.COLUMNS)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_quality_model": op6_quality_model,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe": op8_bpe,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_counts": op13_token_counts,
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def _op11_sql(rounds: int = 4) -> str:
    """Components as rows: v (row, part, position, value), and the codebook of each round."""
    usable = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
    out = [
        f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding, len(embedding) AS w FROM embeddings WHERE {usable}),
v AS MATERIALIZED (SELECT r, i // (w // 4) AS part, i % (w // 4) AS pos, CAST(floor(1024 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT *, unnest(range(w)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, r AS e, pos, x FROM v WHERE r < 256)"""
    ]
    for i in range(rounds + 1):
        out.append(f"""d{i} AS MATERIALIZED (SELECT r, part, e, CAST(sum((v.x - b.x) * (v.x - b.x)) AS BIGINT) AS d FROM v JOIN b{i} b USING (part, pos) GROUP BY r, part, e),
a{i} AS MATERIALIZED (SELECT r, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{i} GROUP BY r, part)""")
        if i < rounds:
            out.append(f"""s{i} AS (SELECT part, e, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{i} USING (r, part) GROUP BY part, e, pos),
b{i + 1} AS MATERIALIZED (SELECT part, e, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM b{i} LEFT JOIN s{i} USING (part, e, pos))""")
    out.append(f"""c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN c USING (r) CROSS JOIN h""")
    return ",\n".join(out)


SQL: dict[str, str] = {
    "op11_vector_codes": _op11_sql(),
    "op12_prefix_trie": """
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn IS NOT NULL, turn, coalesce(role, ''), substr(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32)) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (
  SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_concat([CAST(ascii(c) AS BIGINT)], [CAST(0 AS BIGINT) for i in range(7)])))),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h
  FROM t
),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS path FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, CAST(d AS BIGINT) AS depth, path[1:d] AS key, len(path) AS n FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM c)),
g AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM p GROUP BY key, depth),
m AS (SELECT *, row_number() OVER () AS id, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(key[depth].t) END AS saved FROM g),
e AS (SELECT m.id, u.id AS up, u.conv_id AS up_conv FROM m JOIN m u ON m.depth > 0 AND u.depth = m.depth - 1 AND u.key = m.key[1:m.depth - 1]),
k AS (SELECT up AS id, count(*) AS n FROM e GROUP BY up),
a AS (SELECT m.id AS top, d.id AS below FROM m JOIN m d ON d.depth >= m.depth AND d.key[1:m.depth] = m.key),
s AS (SELECT top AS id, CAST(sum(d.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (k.n IS NULL) AS n_leaves FROM a JOIN m d ON d.id = a.below LEFT JOIN k ON k.id = a.below GROUP BY top)
SELECT m.conv_id, m.depth, e.up_conv AS parent_conv_id, m.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(m.ends) AS ends_sha256
FROM m LEFT JOIN e USING (id) LEFT JOIN k USING (id) JOIN s USING (id)""",
    "op4_url_filter": f"""
WITH rules(h, p, v) AS (VALUES {_RULES_SQL}),
u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
)
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)), 'allow') AS verdict
FROM u""",
    "op7_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i + 1], w[i + 2], w[i + 3]) AS n FROM p),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS n_digits
  FROM w LEFT JOIN c USING (r)
),
f AS (SELECT *, CAST(""" + " + ".join(f"CASE WHEN {rule.failed} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality_rules.RULES)) + r""" AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f""",
    "op9_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[i + 1:i + 13], ' ') AS x, least(len(w), 13) AS n FROM (SELECT item, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS x FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, win.n AS n, item FROM place JOIN win ON place.x = win.x AND place.n = win.n),
cover AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, coalesce(items.s, sha256('')) AS items_sha256,
  coalesce(cover.n, 0) > 0 AND 20 * coalesce(cover.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)""",
    "op10_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + 23 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}
