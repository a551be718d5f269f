"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm import digest, langid, linededup, neardup, packing, pages, pieces, quality_model, quotes, rules
from sluice.llm.batches import crc_mod


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; learned from the rows that aren't held out. ``accepted`` is the calibrated rejection's verdict."""
    docs = _documents(spark, sf_dir).withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)))
    model = langid.fit(docs, where=~F.col("held_out"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op2_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every text and of its edited text."""
    return digest.neighbour_digests(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return neardup.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text; learned from the labelled rows that aren't held out."""
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    docs, labels = _documents(spark, sf_dir).withColumn("held_out", held), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit(docs, labels.where(~held))
    return quality_model.score(docs, model, keep=["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    import public_tokenizers

    return packing.pack(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with an end id and decoded again. n_spanned: bytes that the pieces' spans cover; spans_hash: hash of all spans."""
    import public_tokenizers

    encoded = pieces.encode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], outputs=("begins", "ends", "ids_text", "decoded"))
    spanned = (F.element_at("ends", -1) - F.element_at("begins", 1)).cast("long")
    return encoded.select("doc_id", F.size("ends").cast("long").alias("n_tokens"), F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), spanned.alias("n_spanned"), F.xxhash64("begins", "ends").alias("spans_hash"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdict of every document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    judged = rules.judge(docs, keep=["doc_id"])
    return judged.select("doc_id", *rules.BASE[:5], "base_failed", "kept")


OP7_SQL = """
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w WHERE len(words) >= 8),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM starts),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        length(t) - length(regexp_replace(t, '[!-/:-@\\[-`{{-~]', '', 'g')) AS n_punctuation, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN covered c USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {measures} FROM b),
long AS ({long}),
bins AS (SELECT lang, source, measure, v, greatest(length(bin(v)) - 7, 0) AS s FROM long),
sk AS (SELECT lang, source, measure, (v >> s) << s AS bin, count(*) AS n FROM bins GROUP BY ALL),
q0 AS ({level0}), q1 AS ({level1}), q2 AS ({level2}),
cut AS (SELECT q0.lang, q0.source, q0.measure,
          least(CASE WHEN q0.total >= {least} THEN q0.hi END, CASE WHEN q1.total >= {least} THEN q1.hi END, CASE WHEN low OR q0.measure NOT IN ({by_script}) THEN q2.hi END) AS hi,
          greatest(CASE WHEN q0.total >= {least} THEN q0.lo END, CASE WHEN q1.total >= {least} THEN q1.lo END, CASE WHEN low OR q0.measure NOT IN ({by_script}) THEN q2.lo END) AS lo
        FROM (SELECT *, total < {least} AS few FROM q0) q0 JOIN q1 ON q0.lang IS NOT DISTINCT FROM q1.lang AND q0.measure = q1.measure JOIN q2 ON q0.measure = q2.measure, LATERAL (SELECT few AND q1.total < {least} AS low)),
out AS (SELECT DISTINCT long.doc_id FROM long JOIN cut ON long.lang IS NOT DISTINCT FROM cut.lang AND long.source IS NOT DISTINCT FROM cut.source AND long.measure = cut.measure
        WHERE v > hi OR v < lo AND long.measure IN ({two_sided}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out) AS kept FROM m
"""


def _op7_sql() -> str:
    level = lambda by: f"""SELECT *, m - {rules.REACH} * spread AS lo, m + {rules.REACH} * spread AS hi FROM (SELECT *, greatest(least(m - a, z - m), CAST(1 AS BIGINT) << greatest(length(bin(m)) - 7, 0)) AS spread FROM (
        SELECT {by}measure, max(total) AS total, min(bin) FILTER ({rules.TAILS} * c >= total) AS a, min(bin) FILTER (2 * c >= total) AS m, min(bin) FILTER ({rules.TAILS} * c >= {rules.TAILS - 1} * total) AS z FROM
        (SELECT {by}measure, bin, sum(n) OVER (PARTITION BY {by}measure ORDER BY bin) AS c, sum(n) OVER (PARTITION BY {by}measure) AS total
         FROM (SELECT {by}measure, bin, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL))"""  # noqa: E731
    named = lambda names: ", ".join(f"'{k}'" for k in sorted(names))
    return OP7_SQL.format(
        measures=", ".join(f"CAST({e.replace(' div ', ' // ')} AS BIGINT) AS m_{k}" for k, (e, _) in rules.MEASURES.items()),
        long=" UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS measure, m_{k} AS v FROM m WHERE NOT base_failed" for k in rules.MEASURES),
        level0=level("lang, source, "), level1=level("lang, "), level2=level(""), least=rules.MIN_GROUP,
        by_script=named(rules.BY_SCRIPT), two_sided=named(k for k, (_, down) in rules.MEASURES.items() if down),
    )


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five documents or more hold, save in the largest doc_id."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return linededup.without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
common AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, common.key IS NOT NULL AND doc_id <> last AS gone FROM l LEFT JOIN common USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, with the message that it replies to and its place in the conversation."""
    out = quotes.unquoted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "role", F.col("own_text").alias("text"), *quotes.RESULTS[1:])


OP10_SQL = r"""
WITH RECURSIVE l AS (SELECT conv_id, turn, i, line, length(replace(replace(regexp_extract(line, '^(?:[ \t]*>)+', 0), ' ', ''), chr(9), '')) AS level
    FROM (SELECT conv_id, turn, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS s FROM conversations))),
p AS (SELECT *, NOT (coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) > level AND regexp_matches(line, '(?i)^[ \t>]*on\b.*\bwrote[ \t]*:[ \t\r]*$')) AS said,
    translate(trim(regexp_replace(regexp_replace(line, '^(?:[ \t]*>)+', ''), '[\x20\x09-\x0D\x1C-\x1F]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS bare FROM l),
n AS (SELECT *, CASE WHEN said THEN bare ELSE '' END AS s FROM p),
starts AS (SELECT *, CASE WHEN lag(level) OVER w = level AND lag(s) OVER w <> '' THEN 0 ELSE 1 END AS starts FROM n WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM starts),
passages AS (SELECT conv_id, turn, run, max(level) AS level, string_agg(s, ' ' ORDER BY i) AS s FROM runs WHERE s <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
cut AS (SELECT conv_id, turn, level, unnest(string_split(regexp_replace(s, '([.!?]) ', '\1' || chr(29), 'g'), chr(29))) AS s FROM passages),
sentences AS (SELECT * FROM cut WHERE length(s) >= 12),
said AS (SELECT DISTINCT conv_id, s, turn AS source FROM sentences WHERE level = 0),
quoted AS (SELECT conv_id, turn, level, s, count(*) AS n FROM sentences WHERE level > 0 GROUP BY ALL),
found AS (SELECT q.conv_id, q.turn, q.level, q.s, any_value(q.n) AS n, max(source) AS source FROM quoted q JOIN said ON q.conv_id = said.conv_id AND q.s = said.s AND source < q.turn GROUP BY ALL),
per AS (SELECT conv_id, turn, source, sum(n) AS n, sum(n) FILTER (WHERE level = 1) AS n1 FROM found GROUP BY ALL),
links AS (SELECT conv_id, turn, sum(n) AS n_linked, arg_max(source, n1 * 1000000 + source) FILTER (WHERE n1 > 0) AS reply_to FROM per GROUP BY ALL),
up AS (SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM links WHERE reply_to IS NOT NULL
    UNION ALL SELECT up.conv_id, up.turn, links.reply_to, depth + 1 FROM up JOIN links ON up.conv_id = links.conv_id AND up.thread = links.turn WHERE links.reply_to IS NOT NULL),
place AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(thread, depth) AS thread FROM up GROUP BY ALL),
own AS (SELECT conv_id, turn, count(*) FILTER (WHERE level > 0) AS n_quoted, max(level) AS max_level,
    trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE said AND level = 0), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM p GROUP BY ALL),
placed AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN max_level > 0 THEN bare ELSE coalesce(c.text, '') END AS text, CAST(n_quoted AS BIGINT) AS n_quoted, CAST(max_level AS BIGINT) AS max_level,
    CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, reply_to, coalesce(thread, c.turn) AS thread, CAST(coalesce(depth, 0) AS BIGINT) AS depth
  FROM conversations c JOIN own USING (conv_id, turn) LEFT JOIN links USING (conv_id, turn) LEFT JOIN place USING (conv_id, turn))
SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY thread, depth, turn) - 1 AS BIGINT) AS position FROM placed
"""


QUERIES = {"op1_language": op1_language, "op2_digests": op2_digests, "op3_neardup": op3_neardup, "op4_quality": op4_quality, "op5_packing": op5_packing, "op6_pieces": op6_pieces, "op7_rules": op7_rules, "op8_pages": op8_pages, "op9_lines": op9_lines, "op10_quotes": op10_quotes}
ORACLES: dict[str, str] = {"op7_rules": _op7_sql(), "op9_lines": OP9_SQL, "op10_quotes": OP10_SQL}
