"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyscope.llm import archives, benchmark_leaks, checks_sql, cube_mix, hard_negatives, infill, parity_join, piece_viterbi, quality_rules, secret_forest, sentence_spans, suffix_tree, surrogates, winnowing
from tallyscope.llm.catalog import query
from tallyscope.llm.common import table
from tallyscope.session import checkpoint_folder


@query("op1_cube_mix")
def op1(spark, folder):
    units = cube_mix.mix(table(spark, folder, "documents"))
    rows = units.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return rows.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


@query("op2_winnowing")
def op2(spark, folder):
    return winnowing.fingerprints(table(spark, folder, "documents"))


@query("op3_parity_join", checks_sql.JACCARD_COMPONENTS)
def op3(spark, folder):
    return parity_join.jaccard_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op4_piece_viterbi")
def op4(spark, folder):
    return piece_viterbi.encoded(table(spark, folder, "documents"))


@query("op5_quality_rules")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    rules = quality_rules.fit(docs, table(spark, folder, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_secret_forest")
def op6(spark, folder):
    return secret_forest.scanned(table(spark, folder, "documents"))


@query("op7_sentence_spans")
def op7(spark, folder):
    return sentence_spans.deduplicated(table(spark, folder, "documents"))


@query("op8_arc_converter", checks_sql.WARC_PAGES)
def op8(spark, folder):
    files = archives.as_arc(table(spark, folder, "pages"))
    path = f"{checkpoint_folder(spark).rstrip('/')}/tallyscope/warc-{uuid.uuid4().hex}"
    archives.write_warc(archives.with_revisits(archives.converted(files), least_bytes=0), path)
    pages = archives.read_warc(spark, path).where("record_type IN ('response', 'revisit')")
    return archives.with_referred_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@query("op9_surrogates")
def op9(spark, folder):
    return surrogates.replaced(table(spark, folder, "documents")).select("doc_id", "text", "n_entities")


@query("op10_suffix_tree")
def op10(spark, folder):
    return suffix_tree.score(table(spark, folder, "documents"))


@query("op11_fm_index", checks_sql.BENCHMARK_HITS)
def op11(spark, folder):
    found = benchmark_leaks.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.begin)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query("op12_fill_in_middle", checks_sql.FILL_IN_MIDDLE)
def op12(spark, folder):
    made = infill.transformed(table(spark, folder, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


@query("op13_hard_negatives", checks_sql.HARD_NEGATIVES)
def op13(spark, folder):
    return hard_negatives.mined(table(spark, folder, "embeddings"))


@query("pipeline")
def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
