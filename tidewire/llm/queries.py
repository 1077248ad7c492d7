"""The queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, checking_sql, decontamination, embedding_dedup, fill_in_middle, language_id, line_dedup, lm_scoring, minhash_dedup, quality, sharding, spelling, toxicity, url_reputation
from tidewire.llm.sampling import remainder
from tidewire.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the setting ``tidewire.text.tasks`` says that the file of documents has too few row groups."""
    df, tasks = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.conf.get("tidewire.text.tasks", None)
    return spread(df, "doc_id", int(tasks)) if tasks and name == "documents" else df


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels a quality model may learn from."""
    return table(spark, sf_dir, "labels").where(remainder(5) != 0).select("doc_id", F.col("quality").alias("label"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_labels(spark, sf_dir))
    return scored.select(
        "doc.doc_id",
        F.coalesce(remainder(5, "doc.doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, and where they would be with one more."""
    tree = sharding.even_tree(24)
    return sharding.shard_documents(table(spark, sf_dir, "documents"), tree, sharding.grown(tree, "region0", "rack1"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of all documents."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of repeated line runs."""
    cleaned = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc.doc_id", "text", "n_kept", "n_removed", "words_removed")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    labels = table(spark, sf_dir, "labels").where(remainder(3) != 1).select("doc_id", "toxic")
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select(
        "doc.doc_id",
        F.coalesce(remainder(3, "doc.doc_id") == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = table(spark, sf_dir, "documents")
    named = language_id.identify(docs.select("doc_id", "text"), docs.where(remainder(5) != 0).select("doc_id", "text", "lang"))
    return named.select(
        "doc.doc_id", F.coalesce(remainder(5, "doc.doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted"
    )


URL_RULES = [
    url_reputation.Rule("allow", "org/"),
    url_reputation.Rule("block", "example.org/es/"),
    url_reputation.Rule("block", "example.org/en/1"),
    url_reputation.Rule("allow", "com/fr/"),
    url_reputation.Rule("block", "com/de/"),
]


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages; the number that ends a path is the id of the document that the page holds."""
    number = F.regexp_extract(url_reputation.host_and_path(F.col("url"))[1], "/([0-9]+)$", 1).try_cast("long")
    judged = url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES, document=number)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on shingles of four words."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents."""
    docs = table(spark, sf_dir, "documents")
    language, counts = lm_scoring.fit(docs.where(remainder(10) != 0), vocabulary())
    scored = lm_scoring.score(docs, language, counts)
    held_out = F.coalesce(remainder(10) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all documents."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and digests of all documents, rearranged and restored."""
    return fill_in_middle.rearranged(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_quality, op2_sharding, op3_bpe, op4_decontamination, op5_line_dedup, op6_toxicity, op7_language_id, op8_url_reputation, op9_embedding_dedup, op10_minhash)
    return {f.__name__: f for f in (*first, op11_lm_scoring, op12_spelling, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": checking_sql.DECONTAMINATION,
        "op8_url_reputation": checking_sql.url_verdicts(URL_RULES, url_reputation.reputation_sql(), url_reputation.LIMIT),
        "op9_embedding_dedup": checking_sql.NEAR_VECTORS,
        "op13_fill_in_middle": checking_sql.FILL_IN_MIDDLE,
    }
