"""Queries: tokens, vocabulary, encoding, windows, padding, masks (survey 2.3, 2.4, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.catalog.common import longs, table, with_ctes
from textlab.functions import arrays as A, text as T
from textlab.operators import stats, tokens
from textlab.registry import query
from textlab.sources import fixtures as fx

VOCAB_SQL = """vocab AS (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 3)::BIGINT AS id, n FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM doc_tokens) GROUP BY token)
  ORDER BY n DESC, token LIMIT 1000),
ex AS (SELECT doc_id, unnest(range(len(tokens))) AS p, unnest(tokens) AS token FROM doc_tokens),
enc AS (SELECT ex.doc_id, list(coalesce(v.id, 1) ORDER BY ex.p) AS ids
        FROM ex LEFT JOIN vocab v USING (token) GROUP BY ex.doc_id)"""

WIN = "list_concat({t}[1:382], {t}[greatest(len({t}) - 128 + 1, 1):len({t})])"


def doc_tokens(spark, sf_dir):
    return fx.doc_tokens(spark, sf_dir)


def vocab(spark, sf_dir):
    return tokens.build_vocab(doc_tokens(spark, sf_dir), "tokens", max_size=1000)


@query("tokenize_text", with_ctes("doc_tokens") + """
SELECT doc_id::BIGINT AS doc_id, len(tokens)::BIGINT AS n_tokens, tokens[1] AS first_token,
       tokens[-1] AS last_token FROM doc_tokens""")
def q_tokenize(spark, sf_dir):
    d = tokens.tokenize(table(spark, sf_dir, "documents"), "text", "tokens")
    return longs(d.select("doc_id", F.size("tokens").alias("n_tokens"), F.get("tokens", 0).alias("first_token"),
                          F.try_element_at("tokens", F.lit(-1)).alias("last_token")))


@query("build_vocab", with_ctes("doc_tokens", extra=VOCAB_SQL) + "SELECT token, id, n::BIGINT AS n FROM vocab")
def q_build_vocab(spark, sf_dir):
    return longs(vocab(spark, sf_dir))


@query("encode_tokens", with_ctes("doc_tokens", extra=VOCAB_SQL) + """
SELECT doc_id::BIGINT AS doc_id, len(ids)::BIGINT AS n_ids, array_to_string(ids, ' ') AS ids FROM enc""")
def q_encode(spark, sf_dir):
    e = tokens.encode_tokens(doc_tokens(spark, sf_dir), vocab(spark, sf_dir), "tokens", "ids")
    return longs(e.select("doc_id", F.size("ids").alias("n_ids"), A.array_to_text("ids").alias("ids")))


@query("head_tail_window", with_ctes("doc_tokens") + f"""
SELECT doc_id::BIGINT AS doc_id, len(w)::BIGINT AS n, array_to_string(w, ' ') AS window_text
FROM (SELECT doc_id, {WIN.format(t='tokens')} AS w FROM doc_tokens)""")
def q_window(spark, sf_dir):
    d = tokens.window_tokens(doc_tokens(spark, sf_dir), "tokens", 382, 128, "w")
    return longs(d.select("doc_id", F.size("w").alias("n"), F.array_join("w", " ").alias("window_text")))


@query("add_special_tokens", with_ctes("doc_tokens") + """
SELECT doc_id::BIGINT AS doc_id, len(t)::BIGINT AS n, t[1] AS first_token, t[2] AS second_token,
       t[-1] AS last_token FROM (SELECT doc_id, list_concat(['[CLS]'], tokens, ['[SEP]']) AS t FROM doc_tokens)""")
def q_special(spark, sf_dir):
    d = doc_tokens(spark, sf_dir).withColumn("t", A.add_special_tokens("tokens"))
    return longs(d.select("doc_id", F.size("t").alias("n"), F.get("t", 0).alias("first_token"),
                          F.get("t", 1).alias("second_token"), F.element_at("t", -1).alias("last_token")))


PADDED_SQL = VOCAB_SQL + f""",
wids AS (SELECT doc_id, list_concat([2], {WIN.format(t='ids')}, [3]) AS w FROM enc),
padded AS (SELECT doc_id, list_concat(w, [0 for x in range(512 - len(w))]) AS p FROM wids)"""


def padded(spark, sf_dir):
    """window the tokens first, then encode (element-wise, so the same ids as
    encoding everything and windowing the ids), then CLS/SEP and padding."""
    d = tokens.window_tokens(doc_tokens(spark, sf_dir), "tokens", 382, 128)
    e = tokens.encode_tokens(d, vocab(spark, sf_dir), "tokens", "ids")
    e = e.withColumn("w", F.concat(F.array(F.lit(2)), F.col("ids"), F.array(F.lit(3))))
    return e.withColumn("p", A.pad_to_length(F.col("w"), 512))


@query("pad_to_length", with_ctes("doc_tokens", extra=PADDED_SQL) + """
SELECT doc_id::BIGINT AS doc_id, len(p)::BIGINT AS n, array_to_string(p, ' ') AS ids FROM padded""")
def q_pad(spark, sf_dir):
    p = padded(spark, sf_dir)
    return longs(p.select("doc_id", F.size("p").alias("n"), A.array_to_text("p").alias("ids")))


@query("attention_mask", with_ctes("doc_tokens", extra=PADDED_SQL) + """
SELECT doc_id::BIGINT AS doc_id, array_to_string(list_transform(p, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS mask FROM padded""")
def q_mask(spark, sf_dir):
    p = padded(spark, sf_dir).withColumn("m", A.attention_mask("p"))
    return longs(p.select("doc_id", A.array_to_text("m", "").alias("mask")))


@query("max_tokens", with_ctes("doc_tokens", extra=VOCAB_SQL) + """
SELECT max(len(ids) + 2)::BIGINT AS max_len FROM enc""")
def q_max_tokens(spark, sf_dir):
    """Encoding keeps the number of tokens, so the longest row is known without it."""
    return stats.max_tokens(doc_tokens(spark, sf_dir).withColumn("t", A.add_special_tokens("tokens")), "t")


@query("encode_tokens_join", with_ctes("doc_tokens", extra=VOCAB_SQL) + """
SELECT doc_id::BIGINT AS doc_id, array_to_string(ids, ' ') AS ids FROM enc""")
def q_encode_join(spark, sf_dir):
    """The way for vocabularies beyond the broadcast bound (here of no bytes)."""
    e = tokens.encode_tokens(doc_tokens(spark, sf_dir), vocab(spark, sf_dir), "tokens", "ids", max_broadcast_bytes=0)
    return longs(e.select("doc_id", A.array_to_text("ids").alias("ids")))


@query("encode_text", with_ctes("doc_tokens", extra=PADDED_SQL) + """,
longest AS (SELECT max(len(w)) AS n FROM wids)
SELECT doc_id::BIGINT AS doc_id, array_to_string(list_concat(w, [0 for x in range(n - len(w))]), ' ') AS input_ids,
       repeat('1', len(w)) || repeat('0', (n - len(w))::BIGINT) AS mask FROM wids, longest""")
def q_encode_text(spark, sf_dir):
    """Text to padded ids and mask by a vocabulary, padded to the longest row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = tokens.encode_text(d, vocab(spark, sf_dir), "text", 382, 128, "max")
    return longs(e.select("doc_id", A.array_to_text("input_ids").alias("input_ids"), A.array_to_text("attention_mask", "").alias("mask")))


@query("text_length", "SELECT doc_id::BIGINT AS doc_id, length(text)::BIGINT AS n_chars FROM documents")
def q_text_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return longs(d.select("doc_id", T.text_length("text").alias("n_chars")))


@query("contains_mention", with_ctes("sections") + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, contains(section_txt, source)::BIGINT AS hit,
       contains(section_txt, '')::BIGINT AS empty_hit FROM sections""")
def q_contains(spark, sf_dir):
    s = fx.sections(spark, sf_dir)
    return longs(s.select("file_id", "pos", T.contains_mention("section_txt", "source").alias("hit"),
                          T.contains_mention("section_txt", F.lit("")).alias("empty_hit")))


@query("replace_char", """
SELECT doc_id::BIGINT AS doc_id, replace(text, '$', ' ') AS text FROM documents WHERE contains(text, '$')""")
def q_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("$")))
    return longs(d.select("doc_id", T.replace_char("text").alias("text")))
