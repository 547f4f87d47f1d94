"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, hamming_search, language_id, mixing, near_duplicates, quality, sharding, token_counts, toxicity
from .shared import crc_of_id, table


@functools.cache
def _ranks(path: str):
    return bpe.read_ranks(path)


def op1_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.tiktoken")) -> DataFrame:
    """Every text as ids of the rank file and back, as digests."""
    out = bpe.encode(table(spark, sf_dir, "documents"), _ranks(path), public_tokenizers.PATTERN, decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels.toxic outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels").filter(crc_of_id() % 5 != 0))
    out = toxicity.score(docs.withColumn("held_out", crc_of_id() % 5 == 0), net, keep=("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(crc_of_id() % 5 != 0))
    return language_id.predict(docs.withColumn("held_out", crc_of_id() % 5 == 0), model, keep=("doc_id", "held_out"))


def op5_token_counts(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.json"), limit: int = 512) -> DataFrame:
    """Tokens of every text by the tokenizer file, and whether they exceed the limit."""
    merges, special = token_counts.read_merges(path)
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), merges, special, public_tokenizers.PATTERN)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents on a ring of shards, counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.assign(docs, ["doc_id", "size", "text_crc32"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Target weights of the mixture; nodes that aren't named weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2}}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a mixture of three fifths of all tokens takes, in at most two epochs."""
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, (3, 5), max_epochs=2, seed=17)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, by rules learned from labels.quality."""
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(quality.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return quality.judge(docs.select("doc_id", "text"), rules).select("doc_id", *quality.STATISTICS, "base_failed", "kept", "rule")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a tree and counts of the training four fifths."""
    docs = table(spark, sf_dir, "documents")
    tree, words = ctw.train(docs.filter(crc_of_id() % 5 != 1))
    out = ctw.score(docs.withColumn("held_out", crc_of_id() % 5 == 1), tree, words, keep=("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_length")


def op9_hamming_top_k(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The k nearest of all vectors' codes for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return hamming_search.top_k(rows, rows.filter("vec_id % 50 = 0"), k)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document: five-word shingles, similarity of 0.8 or more."""
    found = near_duplicates.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_scores": op8_lm_scores,
    "op9_hamming_top_k": op9_hamming_top_k,
    "op10_near_duplicates": op10_near_duplicates,
}

def mixing_sql(docs: str, share: tuple[int, int], max_epochs: int, seed: int) -> str:
    """Common table expressions of DuckDB that end in `taken`: all columns of docs, domain, n_tokens and epoch."""

    def weight(level: str) -> str:
        return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"

    parts = [
        f"""slim AS (
            SELECT d.*, coalesce(d.lang, '') AS lang_, coalesce(d.source, '') AS source_, md5(coalesce(d.text, '')) AS digest_,
                   CASE WHEN regexp_extract(coalesce(d.source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
                        ELSE 'd' || (CAST(regexp_extract(d.source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) END AS domain_,
                   len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens_
            FROM {docs} d)""",
        f"leaves AS (SELECT domain_, lang_, source_, sum(n_tokens_) AS tokens, sum(n_tokens_) * {max_epochs} AS cap FROM slim GROUP BY ALL)",
    ]
    levels, above = ["domain", "lang", "source"], None
    for n, level in enumerate(levels):
        path = ", ".join(f"{x}_" for x in levels[: n + 1])
        parents = ", ".join(f"{x}_" for x in levels[:n])
        family = f"PARTITION BY {parents}" if parents else ""
        budget = f"(SELECT sum(tokens) * {share[0]} // {share[1]} FROM leaves)" if above is None else "a.own"
        source = "c" if above is None else f"c JOIN {above} a USING ({parents})"
        parts += [
            f"c{n} AS (WITH c AS (SELECT {path}, sum(cap) AS cap, {weight(level).replace('CASE ' + level, 'CASE ' + level + '_')} AS w FROM leaves GROUP BY ALL) SELECT c.*, {budget} AS b FROM {source})",
            f"""f{n} AS (SELECT *, cap * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                     <= w * (b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS whole_
                FROM c{n} WINDOW o AS ({family} ORDER BY cap * 1000000 // w, {level}_))""",
            f"""b{n} AS (SELECT {path}, CASE WHEN whole_ THEN cap ELSE w * (b - coalesce(sum(cap) FILTER (whole_) OVER ({family}), 0))
                     // sum(w) FILTER (NOT whole_) OVER ({family}) END AS own FROM f{n})""",
        ]
        above = f"b{n}"
    parts += [
        "plan AS (SELECT domain_, lang_, source_, own // tokens AS whole_, own % tokens AS rest_ FROM b2 JOIN leaves USING (domain_, lang_, source_) WHERE tokens > 0)",
        f"hashed AS (SELECT *, md5(concat_ws(':', '{seed}', CAST(whole_ AS BIGINT), coalesce(CAST(doc_id AS VARCHAR), ''), digest_)) AS h_ FROM slim JOIN plan USING (domain_, lang_, source_))",
        "summed AS (SELECT *, sum(n_tokens_) OVER (PARTITION BY domain_, lang_, source_ ORDER BY h_ RANGE UNBOUNDED PRECEDING) AS cum_ FROM hashed)",
        "taken AS (SELECT *, unnest(range(CAST(whole_ + CASE WHEN cum_ <= rest_ THEN 1 ELSE 0 END AS BIGINT))) AS epoch_ FROM summed)",
    ]
    return ",\n".join(parts)


#: DuckDB SQL for the queries that it can express; the tests compare the others with brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_mixing": f"""
        WITH {mixing_sql("documents", (3, 5), 2, 17)}
        SELECT doc_id, domain_ AS domain, lang_ AS lang, source_ AS source, CAST(n_tokens_ AS BIGINT) AS n_tokens, epoch_ AS epoch FROM taken
    """,
    "op9_hamming_top_k": """
        WITH codes AS (
            SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
            FROM codes q, codes c WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs
        )
        SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
    """,
}
