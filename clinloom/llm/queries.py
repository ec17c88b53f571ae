"""The registered queries of this subpackage, one for each operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm import conversation_repair, extendible_shards, language_id, ngram_jaccard, nnls_pack, pfair_mix, pii_feistel, prefix_hash, quality_cnn, source_divergence, substring_dedup, transport_stream, unigram_count

SHARD_BYTES = 8 << 20


def byte_bpe() -> str:
    """The public byte-level vocabulary's path, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a transport stream, read back: digests of payload and stream, and its shape."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    read = transport_stream.with_program(transport_stream.with_media(docs))
    p = F.col("program")
    return read.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        *[p[c].alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")],
        transport_stream.feature(p).alias("feature"),
    )


#: Documents with a score of at least this are predicted to have label 1.
QUALITY_KEEP = 0.3


def _fold(of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids are in no fold but 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(0))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the byte network fitted on the labelled rows outside fold 0 of 5."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _fold(5) != 0)
    scored = quality_cnn.score(docs, model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_KEEP).cast("int").alias("predicted"))


#: Key of the registered queries. A deployment passes its own secret.
PII_KEY = "registered-query-key"


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data and credentials, and their spans."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = pii_feistel.pseudonymize(docs, PII_KEY)
    return out.select("doc_id", "text", F.size("pii").alias("n_pii"), F.to_json("pii").alias("pii"))


def op4_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness and the next document's."""
    return prefix_hash.edited_neighbours(_documents(spark, sf_dir))


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, release, deadline and slot; targets are tempered source sizes."""
    return pfair_mix.mix(_documents(spark, sf_dir).select("doc_id", "source"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the model fitted outside fold 1 of 3."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.train(docs, _fold(3) != 1)
    named = language_id.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op7_unigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of unigram pieces and the score of its best segmentation."""
    import public_tokenizers

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return unigram_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op8_nnls_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 ids."""
    return nnls_pack.pack(_documents(spark, sf_dir), byte_bpe())


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component and number of links: three-word shingles, Jaccard of at least 0.9."""
    return ngram_jaccard.join_components(_documents(spark, sf_dir), words=3, num=90, den=100, links=True)


def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, by hash of doc_id, no shard over 8 MiB of text."""
    return extendible_shards.assign_shards(_documents(spark, sf_dir), "doc_id", F.octet_length("text"), SHARD_BYTES)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after the dealt damage, its cheapest repair and the repaired rows' digest."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    broken = conversation_repair.damaged(turns)
    found = conversation_repair.with_all(conversation_repair.audits(broken), turns)
    return conversation_repair.digests(broken, found)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source's terms differ from the other sources' of its language, and which it uses more than its language."""
    return source_divergence.divergence(_documents(spark, sf_dir).select("text", "lang", "source"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words every document loses to documents of smaller ids, and the digest of what it keeps."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    left = substring_dedup.kept(docs, substring_dedup.repeats(docs))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return left.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_transport_stream": op1_transport_stream,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_pii_feistel": op3_pii_feistel,
    "op4_prefix_hash": op4_prefix_hash,
    "op5_pfair_mix": op5_pfair_mix,
    "op6_language_id": op6_language_id,
    "op7_unigram_count": op7_unigram_count,
    "op8_nnls_pack": op8_nnls_pack,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_extendible_shards": op10_extendible_shards,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_divergence": op12_source_divergence,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    # 45 levels: a bucket of one document needs fewer.
    "op10_extendible_shards": f"""WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT x AS depth, h >> (60 - x) AS p, sum(n_bytes) AS b FROM d, range(0, 45) t(x) GROUP BY ALL),
f AS (SELECT doc_id, n_bytes, h, min(depth) AS depth FROM d JOIN s ON h >> (60 - depth) = p WHERE b <= {SHARD_BYTES} GROUP BY doc_id, n_bytes, h)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth::INTEGER, '0') END AS shard, depth::INTEGER AS depth, 0::BIGINT AS page FROM f""",
    "op12_source_divergence": r"""WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM (SELECT r, lang, source, unnest(w) AS term FROM t) GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(d) >= 30),
g AS (SELECT DISTINCT lang, source FROM t),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own, sum(n) OVER (PARTITION BY lang) AS every, sum(n) OVER (PARTITION BY lang, term) AS m FROM f),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (own + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (m + 5)::HUGEINT) // (every + 5 * v)::HUGEINT AS q FROM s JOIN v USING (lang)),
d AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 50""",
}
