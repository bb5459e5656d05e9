"""Queries and SQL of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import collocations, filter_audit, langid, line_dedup, lm, mixing, order_minhash, pieces, pii, quality, secret_scan, simhash, urls
from barloom.llm.shared import table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode_decode(docs, piece_model(), keep_text=False)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_of_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # A lambda of one argument: Spark would bind a second one, default or not, to the place in the array.
    of = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, pii.KINDS[:4]), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.link_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Literals in the JVM: a list of rows would start Python workers.
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), r, strict=True)]) for r in urls.RULES])))
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules, words=urls.HOST_WORDS).select("page_id", "host", "path", "rule", "verdict")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.fingerprint_with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        order_minhash.hexadecimal_column("signature").alias("fingerprint"), order_minhash.hexadecimal_column("edited_signature").alias("edited_fingerprint"),
        order_minhash.alike("signature", "edited_signature").alias("near_edited"), order_minhash.alike("signature", "next_signature").alias("near_next"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op1_language_id": op1_language_id, "op2_sentencepiece": op2_sentencepiece, "op3_quality_rules": op3_quality_rules, "op4_pii": op4_pii, "op5_simhash": op5_simhash, "op6_secret_scans": op6_secret_scans, "op7_url_filters": op7_url_filters, "op8_lm_scoring": op8_lm_scoring, "op9_mixing": op9_mixing, "op10_order_minhash": op10_order_minhash, "op11_filter_audit": op11_filter_audit, "op12_line_dedup": op12_line_dedup, "op13_collocations": op13_collocations}
ORACLES = {"op3_quality_rules": quality.ORACLE, "op7_url_filters": urls.ORACLE, "op9_mixing": mixing.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_line_dedup": line_dedup.ORACLE, "op13_collocations": collocations.ORACLE}
