"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, chat, embedding_dedup, exact_dedup, mixing, phrases, quality, secrets, sharding, simhash, substring_dedup, token_files, whitening
from marginalia.session import cut, table


def held_out(doc_id: Column) -> Column:
    """The third of all ids that no model here learns labels from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    decimals = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimals, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, width=4, budget=4)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = token_files.new_folder(spark)
    token_files.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, folder, with_ids=False)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    report = exact_dedup.exact_duplicates(docs)
    return report.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role")
    trial = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), roles)
    trial = trial.withColumn("turn", F.col("turn").cast("long")).withColumn("text", F.lit("\\### Assistant: </turn> ok"))
    # written once: the texts are read for their turns and again for their examples
    back = chat.read_back(cut(chat.format_conversations(stored.unionByName(trial))))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("examples").alias("n_examples"),
        "context_chars",
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models, _ = secrets.learnt(docs)
    found = secrets.scan(docs, models)
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("base_spans"), k).alias(f"n_{b[0]}") for k, b in enumerate(secrets.BASE)],
        F.sha2(secrets.written(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.written(F.col("all_spans")).alias("spans"),
    )


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = quality.score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return packed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "words")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=4)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


OP6_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""

OP8_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
f AS (
  SELECT *, length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(replace(role, '<', ''), '>', ''))) + 12 AS head,
         length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(replace(text, '<', ''), '>', ''))) + 8 AS tail FROM c),
p AS (
  SELECT *, sum(head + tail) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tail AS context FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(head + tail)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples,
       coalesce(sum(context) FILTER (role = 'assistant'), 0)::BIGINT AS context_chars
FROM p GROUP BY conv_id
"""

OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) AS place FROM d GROUP BY source),
w AS (
  SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS wanted FROM w),
l AS (
  SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r),
t AS (
  SELECT source, source_size, least(cap, coalesce(
           (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, place LIMIT 1) * weight, cap)) AS target,
         ('0x' || substr(md5('7:' || coalesce('s' || source, 'null')), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS start
  FROM l),
k AS (
  SELECT *, greatest(length(bin(size)) - 4, 0) AS shift,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 8))::UBIGINT % (SELECT greatest(64, ceil(count(*) / 4000000.0))::UBIGINT FROM d) AS salt FROM d),
o AS (
  SELECT doc_id, source, size,
         row_number() OVER (PARTITION BY source ORDER BY shift * 16 + (size >> shift), salt, size, doc_id) AS rank FROM k),
x AS (
  SELECT doc_id, size, source_size, target, rank, start,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rank * rate + start) - floor((rank - 1) * rate + start)) * size)::BIGINT AS taken FROM x
"""

OP12_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM s),
f AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS n
  FROM i, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
x AS (
  SELECT k.lang, k.phrase, k.m, a, k, l.n AS l, r.n AS r, (1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1 : k], ' ')
         JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1 : k.m], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[1 : 2], ' ') AS phrase FROM c WHERE m = 3
    UNION ALL SELECT lang, a, array_to_string(w[2 : 3], ' ') FROM c WHERE m = 3) GROUP BY ALL),
d AS (
  SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, encode(y.phrase)) AS rank
  FROM y LEFT JOIN o ON y.lang = o.lang AND y.phrase = o.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT d.lang, rank, phrase, a, l, r, t.n, score::BIGINT AS score FROM d JOIN t ON t.lang = d.lang WHERE rank <= 2000
"""

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_simhash": op4_simhash,
    "op5_token_files": op5_token_files,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_chat_format": op8_chat_format,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_ranking": op10_quality_ranking,
    "op11_balanced_shards": op11_balanced_shards,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op6_exact_dedup": OP6_SQL, "op7_source_mix": OP7_SQL, "op8_chat_format": OP8_SQL, "op12_collocations": OP12_SQL}
