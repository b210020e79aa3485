"""The registered queries of this subpackage, one for each operator, with production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctph, langid, lm_score, merkle, neardup, packing, quality, spm, token_counts, topk, url_filters, variants, wrappers
from .common import fold_of, table, vocab
from .oracles import MERKLE, VARIANTS
from .pipeline import run

#: The rules of the url query.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    e = e.where(F.forall("e", finite)).select("vec_id", F.transform("e", lambda x: F.floor(x * 64)).alias("vector"))
    return topk.exact_topk(e, F.col("vec_id") % 20 == 0, 20)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold_of(F.col("doc_id"), 5) == 0
    out = quality.score(docs, quality.fit(docs, labels, held), ["doc_id", held.alias("held_out")])
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "class_node")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model, ["doc_id", held.alias("held_out")])


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spm.encode(table(spark, sf_dir, "documents"), vocab("piece_bpe_32k.model"), decoded="decoded", keep=("doc_id",))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocab("byte_bpe_50k.json"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good).withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = merkle.digest(*[merkle.encoded(F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in columns])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(docs, columns, "lang", "doc_id", {"doc_id": F.col("doc_id"), "tampered": F.when(chosen, tampered)})
    out = out.withColumns({"proof_sha256": F.sha2(merkle.segments(F.col("path")), 256), "folded_root": merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of Latin letters in small letters, of which one in 31 of a document's words loses a letter; null ids count as empty."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z\u00C0-\u00FF]+"), F.lit(0)))
    runs = table(spark, sf_dir, "documents").select("doc_id", found.alias("run")).where(F.length("run") >= 7)
    runs = runs.select("doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = variants.word_counts(runs.select(F.when(F.col("h") % 31 == 0, lost).otherwise(F.col("run")).alias("word")), 7, 2)
    return variants.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocab("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_exact_topk, op3_quality, op4_near_duplicates, op5_language_id, op6_fingerprints, op7_sentencepiece, op8_html_extraction, op9_packing, op10_lm_scores, op11_merkle_manifest, op12_spelling_variants, op13_token_counts, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": MERKLE, "op12_spelling_variants": VARIANTS}
