"""The registered queries of the training-data operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, collocations, digest, lm, media, packing, periodic, quality, sharding, simhash, simple8b, toxicity, zipwarc
from .common import cut, held_out, scratch, text_bytes

N_SHARDS = 24


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: the map from virtual slots to shards levels the shards' bytes.

    Version 1 of the map deals the slots out in turn; version 2 is its edit by the slots' bytes, which moves only what the
    level needs. The rows go by version 2.
    """
    body = text_bytes()
    rows = _documents(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + sharding.ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = cut(rows.withColumn("virtual_slot", sharding.virtual_slot(F.col("doc_id"), F.col("text_crc32"))))
    sums = sharding.slot_sums(rows)
    path = scratch(spark, "shard-map")
    first = [s % N_SHARDS for s in range(sharding.N_SLOTS)]
    for version, shards in ((1, first), (2, sharding.rebalance(first, sums, N_SHARDS, slack=0.0))):
        sharding.write_map(spark, path, sharding.map_rows(shards, sums, version))
    placed = sharding.assign(rows, sharding.read_map(spark, path), ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op2_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_next(_documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = zipwarc.write_archives(zipwarc.record_types(pages), scratch(spark, "archives"))
    return zipwarc.read_archives(spark, manifest)


OP4_SQL = """
WITH r AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS winner FROM r WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT r.page_id, r.payload_bytes, r.payload_digest,
       CASE WHEN g.winner IS NULL OR g.winner = r.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.winner IS NULL OR g.winner = r.page_id THEN NULL ELSE g.winner END AS refers_to
FROM r LEFT JOIN g ON r.payload_digest = g.payload_digest AND r.payload_bytes >= 1000
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digest_round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = media.media_round_trip(_documents(spark, sf_dir))
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256")


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = simple8b.write_ids(_documents(spark, sf_dir), scratch(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return simple8b.read_ids(spark, manifest)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).scored(docs)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).scored(docs)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM pieces),
ones AS (SELECT lang, id, unnest(w) AS phrase, generate_subscripts(w, 1) AS i FROM split),
after AS (SELECT lang, phrase AS x, lead(phrase) OVER s AS y, lead(phrase, 2) OVER s AS z FROM ones WINDOW s AS (PARTITION BY id ORDER BY i)),
pairs AS (SELECT lang, x || ' ' || y AS phrase FROM after WHERE y IS NOT NULL),
threes AS (SELECT lang, x || ' ' || y || ' ' || z AS phrase FROM after WHERE z IS NOT NULL),
totals AS (SELECT lang, count(*) AS n FROM ones GROUP BY lang),
f AS MATERIALIZED (SELECT lang, phrase, 1 AS words, count(*) AS c FROM ones GROUP BY lang, phrase HAVING count(*) >= 10 UNION ALL SELECT lang, phrase, 2, count(*) FROM pairs GROUP BY lang, phrase HAVING count(*) >= 10 UNION ALL SELECT lang, phrase, 3, count(*) FROM threes GROUP BY lang, phrase HAVING count(*) >= 10),
candidates AS (SELECT lang, phrase, words, c AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
cuts AS MATERIALIZED (SELECT lang, phrase, words, a, w, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates)),
scored AS (
  SELECT x.lang, x.phrase, x.words, x.a, x.k, x.w, g.c AS l, h.c AS r, CAST(1000000 * CAST(x.a AS HUGEINT) * x.a // (CAST(g.c AS HUGEINT) * h.c) AS BIGINT) AS score
  FROM cuts x JOIN f g ON g.lang = x.lang AND g.phrase = x.head JOIN f h ON h.lang = x.lang AND h.phrase = x.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE words = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.part = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM ranked k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000
"""


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, a tenth of which repeat words by the rule of ``periodic.repeat_from``."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), periodic.repeat_from().alias("text"))
    found = periodic.with_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("_longest", periodic.longest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_longest.start", "_longest.length", "_longest.period",
        F.floor(F.lit(1000) * F.col("_longest.length") / F.col("_longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def digest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_digests: lengths and hashes of the edited texts."""
    return op2_digests(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


DIGEST_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT doc_id, t, n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM d)
SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 2) || left(after, n // 2)) AS edited_sha256 FROM x
"""


def shard_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1_slots: sizes, and that the law of bytes and the gapless places hold."""
    placed = cut(op1_slots(spark, sf_dir))
    loads = placed.groupBy("shard").agg(F.sum("size").alias("load"), F.count("*").alias("rows"), F.count_distinct("slot").alias("places"), F.max("slot").alias("last"))
    level = loads.agg((F.max("load") - F.when(F.count("*") < N_SHARDS, F.lit(0)).otherwise(F.min("load"))).alias("spread"), F.bool_and((F.col("places") == F.col("rows")) & (F.col("last") == F.col("rows") - 1)).alias("gapless"))
    largest = placed.agg(F.max("size").alias("largest"))
    law = F.broadcast(level.join(largest).select((F.col("spread") <= F.col("largest")).alias("is_level"), "gapless"))  # one row
    return placed.select("doc_id", "size").join(law)


SHARD_SQL = "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, true AS is_level, true AS gapless FROM documents"


def media_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6_media: sizes and hashes of payloads and images."""
    return op6_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


MEDIA_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n, greatest(64, (octet_length(b) + 63) // 64 * 64) AS m FROM d),
p AS (SELECT *, b || repeat('\x00'::BLOB, m - n) AS payload, encode('P5' || chr(10) || '64 ' || m // 64 || chr(10) || '255' || chr(10)) AS head FROM n)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256, CAST(m + octet_length(head) AS BIGINT) AS media_bytes, sha256(head || payload) AS media_sha256 FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_slots": op1_slots,
    "op2_digests": op2_digests,
    "op3_packing": op3_packing,
    "op4_archives": op4_archives,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_media": op6_media,
    "op7_id_files": op7_id_files,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_gru": op11_gru,
    "op12_collocations": op12_collocations,
    "op13_runs": op13_runs,
    "shard_loads": shard_loads,
    "digest_edits": digest_edits,
    "media_checksums": media_checksums,
}
#: The last three queries are columns of operators that SQL can say.
ORACLE_SQL: dict[str, str] = {"op4_archives": OP4_SQL, "op12_collocations": OP12_SQL, "shard_loads": SHARD_SQL, "digest_edits": DIGEST_SQL, "media_checksums": MEDIA_SQL}
