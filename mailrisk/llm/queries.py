"""One query per operator over its whole table, and SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.llm import (
    ann, html, langid, licenses, manifest, mixing, neardup_vectors, packing, quality, repair, shards, simhash, sql, urlfilter,
)
from mailrisk.llm.shared import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted"
    )


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of vectors with equal labels and a cosine of at least 0.93."""
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.sample(docs))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rate")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes; equal texts stay together."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    )
    return shards.shard(docs, F.col("text_hash"), F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles and the groups that links of up to four bits make."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.index(vectors), vectors, F.col("vec_id") % 20 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of 150 % of all words."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, its own or that of the nearest directory above it."""
    files = licenses.document_paths(table(spark, sf_dir, "documents"))
    return licenses.scan(files).withColumnRenamed("file_id", "doc_id")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against four rules: the longest that fits, and its verdict."""
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.fixed_rules(spark))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every damaged conversation."""
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every document; a third is tampered with."""
    return manifest.documents_manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_near_vectors": op3_near_vectors,
    "op4_language": op4_language,
    "op5_shards": op5_shards,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_nearest": op8_nearest,
    "op9_mixing": op9_mixing,
    "op10_licences": op10_licences,
    "op11_url_filter": op11_url_filter,
    "op12_conversations": op12_conversations,
    "op13_manifest": op13_manifest,
}

ORACLES: dict[str, str] = {
    "op9_mixing": sql.MIXING,
    "op10_licences": sql.LICENCES,
    "op11_url_filter": sql.URL_FILTER,
    "op12_conversations": sql.CONVERSATIONS,
    "op13_manifest": sql.MANIFEST,
}
