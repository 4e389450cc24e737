"""One named query for each operator of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpgspark.llm import (
    bpe,
    chat,
    collocations,
    hard_negatives,
    language_model,
    mixing,
    nearest,
    quality,
    sharding,
    simhash,
    substrings,
    warc,
)
from cpgspark.llm import repetition as repetition_rules
from cpgspark.plans.durable import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_REPETITION_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), base AS (
  SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), words AS (
  SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d
), windows AS (
  SELECT rid, i, string_agg(w, ' ') OVER short AS w,
         CASE WHEN i + {repetition_rules.MAX_LONGEST} <= n
              THEN string_agg(w, ' ') OVER long END AS long_w
  FROM words
  WINDOW short AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING),
         long AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW
                  AND {repetition_rules.MAX_LONGEST} FOLLOWING)
  QUALIFY i + 7 <= n
), repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM windows)
  WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM repeated, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid
), too_long AS (
  SELECT DISTINCT rid FROM (
    SELECT rid, long_w FROM windows WHERE long_w IS NOT NULL
    GROUP BY rid, long_w HAVING count(*) > 1)
), joined AS (
  SELECT b.*, coalesce(c.n, 0) AS rep, l.rid IS NOT NULL AS long_rep
  FROM base b LEFT JOIN covered c USING (rid) LEFT JOIN too_long l ON l.rid = b.rid
)
SELECT doc_id, n_words, word_chars, n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
       CAST(rep AS BIGINT) AS n_repeat_words,
       (n_words < {repetition_rules.MIN_WORDS}
        OR 100 * rep > {repetition_rules.BASE_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {repetition_rules.MIN_WORDS}
            OR 100 * rep > {repetition_rules.BASE_PERCENT} * n_words
            OR 100 * rep > {repetition_rules.MAX_PERCENT} * n_words OR long_rep) AS kept
FROM joined
"""


@query("op6_repetition", _REPETITION_SQL)
def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, symbols, repeats and the verdict on every document."""
    counts = repetition_rules.repetition(table(spark, sf_dir, "documents"))
    return repetition_rules.judge(counts).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    tables = bpe.share_tables(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(documents, tables).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the held-out part."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents, model, keep=["doc_id"]).select(
        "doc_id", quality.held_out().alias("held_out"), "score", "predicted"
    )


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the component it belongs to."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS source_rank,
         {mixing.MAX_PASSES} * source_size AS most
  FROM s
), f AS (
  SELECT *, most::DOUBLE / weight AS fill,
         coalesce(sum(most) OVER o, 0)::BIGINT AS most_before,
         coalesce(sum(weight) OVER o, 0)::BIGINT AS weight_before,
         row_number() OVER (ORDER BY most::DOUBLE / weight, source_rank) AS n
  FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, source_rank
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM w) - most_before)::DOUBLE
            / ((SELECT sum(weight) FROM w) - weight_before)::DOUBLE AS lev
  FROM f
), g AS (
  SELECT source, source_size,
         least(most::DOUBLE, (SELECT arg_min(lev, n) FROM l WHERE fill >= lev) * weight) AS target
  FROM f
), q AS (
  SELECT row_number() OVER () AS rid, d.doc_id, d.size, d.source, g.source_size, g.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), n AS (
  SELECT *, (source_size + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS blocks,
         (quota // source_size) * ((source_size + {mixing.BLOCK - 1}) // {mixing.BLOCK})
         + (quota % source_size + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS slots
  FROM (SELECT source, source_size, round(target)::BIGINT AS quota FROM g WHERE source_size > 0)
), lined AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_slot,
         length(bin((SELECT greatest(sum(slots), 1)::BIGINT FROM n))) AS bits
  FROM n
), points AS (
  SELECT * EXCLUDE (i), (first_slot + i) AS j FROM (SELECT *, unnest(range(slots)) AS i FROM lined)
), turns AS (
  SELECT *, list_sum(list_transform(range(bits), lambda b: ((j >> b) & 1) << (bits - 1 - b)))::BIGINT AS turn
  FROM points
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn) - 1 AS r FROM turns
), placed AS (
  SELECT source, turn, (r % blocks) * {mixing.BLOCK} AS start,
         least((r % blocks) * {mixing.BLOCK} + {mixing.BLOCK}, source_size,
               quota - (r // blocks) * source_size) AS stop
  FROM ranked
), met AS (
  SELECT rid, sum(least(begins + size, stop) - greatest(begins, start))::BIGINT AS taken,
         min(turn) AS first_turn
  FROM q JOIN placed p ON q.source IS NOT DISTINCT FROM p.source
       AND q.begins < p.stop AND q.begins + q.size > p.start AND q.size > 0
  GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_turn
FROM q LEFT JOIN met USING (rid)
"""


@query("op1_mixing", _MIX_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards are near equal in bytes."""
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_WARC_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS body,
         sha1(coalesce(html, '')) AS h
  FROM pages
), bits AS (
  SELECT rid, array_to_string(list_transform(string_split(h, ''), lambda c:
           lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS b
  FROM p
), digest AS (
  SELECT rid, array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + 16 * substr(b, CAST(i * 5 + 1 AS INT), 1)::INT
                    + 8 * substr(b, CAST(i * 5 + 2 AS INT), 1)::INT
                    + 4 * substr(b, CAST(i * 5 + 3 AS INT), 1)::INT
                    + 2 * substr(b, CAST(i * 5 + 4 AS INT), 1)::INT
                    + substr(b, CAST(i * 5 + 5 AS INT), 1)::INT, 1)), '') AS d
  FROM bits
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m JOIN digest USING (rid)
"""


@query("op4_warc", _WARC_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back from the archives."""
    return warc.archived_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op9_nearest")
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rows to every vector whose id 20 divides."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("op10_substrings")
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document holds."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_passages(documents)


@query("op7_language_model")
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a trigram model of the training part."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = language_model.train(documents.where(language_model.learns()))
    return language_model.score(documents, model).select(
        "doc_id",
        language_model.held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


#: The conversation that says the template's own control strings.
_CONTROL_TEXT = "\\### Assistant: </turn> ok"
_CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), marked AS (
  SELECT *, length(text) + length(role) + 14
         + length(regexp_replace(text, '[^\\#]', '', 'g')) + length(regexp_replace(role, '[^\\#:]', '', 'g'))
         + (length(text) - length(replace(text, '</turn>', ''))) // 7
         + (length(role) - length(replace(role, '</turn>', ''))) // 7 AS chars
  FROM rows
), said AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sum(chars)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text)
                  FILTER (role = 'assistant'), '') AS loss
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM said
"""


@query("op11_chat", _CHAT_SQL)
def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted as one, and read back from its parts."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(
        [(-7, 0, "user", _CONTROL_TEXT), (-7, 1, "assistant", _CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    parts = chat.format_paths(chat.linear_replies(given.unionByName(control)))
    return chat.read_back(store(parts, "chat-parts")).select(
        F.col("tree").alias("conv_id"),
        "n_turns",
        "turns_sha256",
        "loss_chars",
        "loss_sha256",
        "formatted_chars",
    )


_NEGATIVES_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0
), p AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS n
  FROM s WHERE same AND vec_id != anchor_id QUALIFY n <= 5
)
SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
       row_number() OVER (PARTITION BY p.rid, p.n ORDER BY score DESC, vec_id)::INTEGER AS rank
FROM p JOIN s ON s.rid = p.rid AND NOT same
     AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query("op12_negatives", _NEGATIVES_SQL)
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive, some labels made wrong first."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=moved)


_PHRASES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents
), p AS (
  SELECT rid, lang, unnest(ps) AS p, unnest(range(len(ps))) AS pid FROM d
), w AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), grams AS (
  SELECT lang, k, list_slice(ws, i, i + k - 1) AS parts, count(*)::BIGINT AS f
  FROM starts, (SELECT unnest(range(1, 6)) AS k)
  WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100
), total AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), cuts AS (
  SELECT lang, parts, k, f AS a, unnest(range(1, k)) AS cut FROM grams WHERE k > 1
), scored AS (
  SELECT c.lang, c.parts, c.a, x.f AS l, y.f AS r, t.n, c.cut,
         ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c
  JOIN grams x ON x.lang = c.lang AND x.parts = list_slice(c.parts, 1, c.cut)
  JOIN grams y ON y.lang = c.lang AND y.parts = list_slice(c.parts, c.cut + 1, c.k)
  JOIN total t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.parts ORDER BY score, c.cut) = 1
), spans AS (
  SELECT lang, parts, k, f, size, unnest(range(1, k - size + 2)) AS i
  FROM (SELECT *, unnest(range(2, k)) AS size FROM grams WHERE k > 2)
), inner_most AS (
  SELECT lang, list_slice(parts, i, i + size - 1) AS parts, max(f) AS longer FROM spans GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang
         ORDER BY score DESC, a DESC, array_to_string(s.parts, ' '))::BIGINT AS rank,
       array_to_string(s.parts, ' ') AS phrase, a, l, r, n, score
FROM scored s LEFT JOIN inner_most m ON m.lang = s.lang AND m.parts = s.parts
WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""


@query("op13_collocations", _PHRASES_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases of two to five words that stand together most."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))
