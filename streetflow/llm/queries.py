"""One query per operator, over whole tables with production parameters, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streetflow.llm import (bpe, buckets, chat, chosen_path, cross_tokens, language, main_text, pu, ring, rules, slice_codes,
                            vamana, warc)
from streetflow.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def count_tokens(docs: DataFrame) -> DataFrame:
    """Real lengths by the rank file of op9."""
    import public_tokenizers

    return bpe.token_counts(docs, rank_file(), public_tokenizers.PATTERN)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its declared language, and its source as host."""
    docs = _table(spark, sf_dir, "documents")
    out = language.identify(language.with_evidence(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")))
    return out.withColumnRenamed("id", "doc_id")


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over every web page, with markup, address suffix and host as evidence."""
    pages = _table(spark, sf_dir, "pages")
    out = language.identify(language.with_evidence(
        pages, "page_id", language.page_text(F.col("html")), language.markup_language(F.col("html")),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))
    return out.withColumnRenamed("id", "page_id")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    parts = turns.unionByName(extra).select("conv_id", "turn", "role", F.array(chat.text_part(F.col("text"))).alias("parts"))
    return chat.digest(chat.format_chats(parts))


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are real tokens of the whole texts, by the rank file of op9."""
    return buckets.pack(count_tokens(_table(spark, sf_dir, "documents")), F.col("n_tokens"))


def op5_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.search(_table(spark, sf_dir, "embeddings"))


def op6_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc-archives").path("archives")
    warc.write_archives(warc.mark_revisits(_table(spark, sf_dir, "pages")), folder, "gzip")
    return warc.page_records(spark, folder)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.filter_by_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), rank_file())


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ring.shard_rows(_table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def op11_slice_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return cross_tokens.alignment(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "page_language_id": page_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_chosen_path": op3_chosen_path,
    "op4_length_buckets": op4_length_buckets,
    "op5_vamana": op5_vamana,
    "op6_warc_chain": op6_warc_chain,
    "op7_quality": op7_quality,
    "op8_adaptive_rules": op8_adaptive_rules,
    "op9_bpe": op9_bpe,
    "op10_ring_shards": op10_ring_shards,
    "op11_slice_codes": op11_slice_codes,
    "op12_main_text": op12_main_text,
    "op13_cross_tokens": op13_cross_tokens,
}


def _codes_sql(rounds: int) -> str:
    """All rounds of op11 as one chain of tables; whole numbers stay below 2^53, so doubles hold them exactly."""
    def assigned(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (
  SELECT p.row_id, p.part, min_by(c.entry, (p.norm + c.norm - 2 * list_inner_product(p.v, c.v)) * 256 + c.entry) AS entry,
         min(p.norm + c.norm - 2 * list_inner_product(p.v, c.v))::BIGINT AS distance
  FROM p JOIN c{k} c ON c.part = p.part GROUP BY 1, 2),"""

    def moved(k: int) -> str:
        return f"""
m{k} AS (
  SELECT part, entry, list(floor(s / n) ORDER BY pos) AS v FROM (
    SELECT a.part, a.entry, g.pos, sum(p.v[g.pos]) AS s, count(*) AS n
    FROM a{k} a JOIN p ON p.row_id = a.row_id AND p.part = a.part JOIN range(1, 17) g(pos) ON true GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (
  SELECT part, entry, v, list_inner_product(v, v) AS norm FROM (
    SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry)),"""

    chain = "".join(assigned(k) + moved(k) for k in range(rounds)) + assigned(rounds)
    return f"""
WITH e AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row_id, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT row_id, part, v, list_inner_product(v, v) AS norm FROM (
    SELECT row_id, part, v[part * 16 + 1:part * 16 + 16] AS v FROM e, range(4) t(part))),
c0 AS (SELECT part, row_id - 1 AS entry, v, norm FROM p WHERE row_id <= 256),{chain}
books AS (
  SELECT sha256(string_agg(c.v[g.pos]::BIGINT::VARCHAR, ',' ORDER BY c.part, c.entry, g.pos)) AS digest FROM c{rounds} c, range(1, 17) g(pos)),
coded AS (
  SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM coded JOIN e USING (row_id), books"""


def _rules_sql() -> str:
    """op8 with exact word windows and lines in place of their hashes."""
    ratio = ", ".join(f"(CASE WHEN {b} > 0 THEN 1000 * {a} // {b} ELSE 0 END)::BIGINT AS {m}" for m, a, b, *_ in rules.METRICS)
    width, digits = 1 << rules.DIGITS, rules.DIGITS
    below, above = ("CASE metric " + " ".join(f"WHEN '{row[0]}' THEN {row[k]}" for row in rules.METRICS if row[k] is not None) + " END" for k in (3, 4))

    def quantiles(name: str, keys: str) -> str:
        listed = f"{keys}, " if keys else ""
        return f"""
{name} AS (
  SELECT {listed}metric, max(n) AS n, coalesce(min(least_) FILTER (upto * 100 >= n * below), 0) AS low,
         min(next_) FILTER (upto * 100 >= n * above) - 1 AS high
  FROM (SELECT *, sum(r) OVER (PARTITION BY {listed}metric) AS n,
               sum(r) OVER (PARTITION BY {listed}metric ORDER BY bucket) AS upto, {below} AS below, {above} AS above,
               ((bucket - greatest(bucket // {width} - 1, 0) * {width}) * 2 ** greatest(bucket // {width} - 1, 0))::BIGINT AS least_,
               ((bucket + 1 - greatest((bucket + 1) // {width} - 1, 0) * {width}) * 2 ** greatest((bucket + 1) // {width} - 1, 0))::BIGINT AS next_
        FROM (SELECT {listed}metric, bucket, sum(r) AS r FROM sketch GROUP BY ALL)) GROUP BY {listed}metric),"""

    inside = " AND ".join(f"{m} BETWEEN max(low) FILTER (metric = '{m}') AND max(high) FILTER (metric = '{m}')" for m, *_ in rules.METRICS)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS words FROM documents),
lines AS (
  SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY 1),
windows AS (
  SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, five) AS n
  FROM (SELECT row_id, pos, array_to_string(words[pos:pos + 4], ' ') AS five
        FROM (SELECT row_id, words, unnest(range(1, len(words) - 3)) AS pos FROM d))),
repeated AS (
  SELECT row_id, count(DISTINCT pos + step) AS n_repeat_words FROM windows, range(5) s(step) WHERE n >= 2 GROUP BY 1),
c AS (
  SELECT row_id, doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[ 	-
]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (row_id) LEFT JOIN repeated USING (row_id)),
m AS (SELECT *, {ratio} FROM c),
cells AS (SELECT lang, source, metric, value FROM (FROM m WHERE n_words >= 10 AND n_repeat_words * 100 <= n_words * 20) UNPIVOT (value FOR metric IN ({", ".join(m for m, *_ in rules.METRICS)}))),
sketch AS (
  SELECT lang, source, metric, greatest(length(bin(value)) - {digits + 1}, 0) * {width} + (value >> greatest(length(bin(value)) - {digits + 1}, 0)) AS bucket,
         count(*) AS r FROM cells GROUP BY ALL),{quantiles("own", "lang, source")}{quantiles("of_lang", "lang")}{quantiles("of_all", "")}
limits AS (
  SELECT o.lang, o.source, o.metric,
         CASE WHEN o.n >= 100 THEN o.low WHEN l.n >= 100 THEN l.low ELSE a.low END AS low,
         CASE WHEN o.n >= 100 THEN o.high WHEN l.n >= 100 THEN l.high ELSE a.high END AS high
  FROM own o JOIN of_lang l ON l.metric = o.metric AND l.lang IS NOT DISTINCT FROM o.lang JOIN of_all a ON a.metric = o.metric)
SELECT any_value(doc_id) AS doc_id, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols,
  any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words,
  any_value(n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed,
  coalesce(any_value(n_words >= 10 AND n_repeat_words * 100 <= n_words * 20) AND {inside}, false) AS kept
FROM m LEFT JOIN limits t ON t.lang IS NOT DISTINCT FROM m.lang AND t.source IS NOT DISTINCT FROM m.source
GROUP BY row_id, word_length, symbols, dup_lines, repeats"""


ORACLES: dict[str, str] = {
    "op8_adaptive_rules": _rules_sql(),
    "op11_slice_codes": _codes_sql(slice_codes.ROUNDS),
    "op3_chosen_path": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s),
f AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n_shingles + y.n_shingles - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
least_ AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN least_ USING (doc_id)""",
    "op6_warc_chain": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
FROM q""",
    "op2_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 24
      + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
      + length(regexp_replace(role, '[<\[](/?s>|/?INST\]|/?SYS\]|/?<?SYS>|<SYS>>|</SYS>>|\|)', '\0~', 'g')) - length(role)
      + length(regexp_replace(text, '[<\[](/?s>|/?INST\]|/?SYS\]|/?<?SYS>|<SYS>>|</SYS>>|\|)', '\0~', 'g')) - length(text)
     )::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
}
