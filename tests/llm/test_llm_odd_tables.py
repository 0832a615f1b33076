"""Empty tables, nulls in every column, repeated rows and extra columns with clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyscope.llm import archives, cube_mix, parity_join, piece_viterbi, quality_rules, secret_forest, sentence_spans, suffix_tree, surrogates, winnowing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["size", "target", "copies", "n_rows", "n_words", "kept", "kind", "match", "canonical", "key", "keys", "set_id", "label", "place", "before", "candidate", "fingerprint", "score", "n_entities", "text_hash", "_id", "_hash", "_empty", "bucket", "word", "n", "a", "b", "_doc", "_has", "_map", "_found", "_parts", "_text", "_words", "_row", "_size", "_n", "_copies", "_copy", "_source", "dotted.name"]
GOOD = " ".join(f"word{i} reads well" for i in range(40)) + ". Mail ann.lee@mail.example.com now."
ROWS = [(1, GOOD, "en", "a", 9), (2, GOOD, "en", "b", 9), (2, GOOD, "en", "b", 9), (None, None, None, None, None), (4, "", "en", None, 0), (5, "x\ny", None, "a", None), (5, "x\ny", None, "a", None)]

OPERATORS = {
    "mix": cube_mix.mix,
    "mixed": cube_mix.mixed,
    "fingerprints": lambda d: winnowing.fingerprints(d, 3),
    "jaccard_groups": parity_join.jaccard_groups,
    "keep_one": parity_join.keep_one,
    "encoded": piece_viterbi.encoded,
    "judge": lambda d: quality_rules.judge(d, []),
    "scanned": secret_forest.scanned,
    "deduplicated": sentence_spans.deduplicated,
    "replaced": surrogates.replaced,
    "score": suffix_tree.score,
}


def clashing(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("extra") for c in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_odd_and_empty_tables(spark, name):
    plain = OPERATORS[name](spark.createDataFrame(ROWS, DOCS))
    wide = OPERATORS[name](clashing(spark, ROWS))
    assert OPERATORS[name](clashing(spark, [])).count() == 0
    assert plain.count() == wide.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_of_their_input(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, 1), (2, 1), (None, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (ROWS, []):
        docs = clashing(spark, rows)
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and (rows or out.count() == 0)
        assert all(r[c] == "extra" for r in out.collect() for c in CLASHES)


def test_archives_take_empty_tables_and_extra_columns(spark, tmp_path):
    for rows in ([(1, "u", "h"), (1, "u", "h"), (None, None, None)], []):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("extra") for c in ("payload", "record_type", "path", "content")})
        path = str(tmp_path / f"w{len(rows)}")
        archives.write_warc(archives.with_revisits(archives.converted(archives.as_arc(pages, 2))), path)
        assert archives.read_warc(spark, path).where("record_type IN ('response', 'revisit')").count() == len(rows)


def test_forest_learns_findings(spark):
    """Held-out accuracy on labelled findings: random hexadecimal keys that are assigned, against long plain names."""
    rows = [(i, f'token = "{abs(hash((i, 1))):016x}{abs(hash((i, 2))):016x}" end' if i % 2 else f"see the release-of-the-library-number-{i} there", "src/app") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_forest.candidates(docs, []).withColumn("label", (F.col("doc_id") % 2).cast("double"))
    out = secret_forest.scanned(docs.where("doc_id >= 200"), found.where("doc_id < 200"), []).collect()
    assert len(out) >= 190 and sum(r.is_secret == (r.doc_id % 2 == 1) for r in out) >= 0.95 * len(out)


def test_assigned_values_are_candidates_in_every_form(spark):
    value, padded, far = "9f86d081884c7d659a2feaa0c55ad015", "dGhpcyBpcyBhIHNlY3JldA9x==", "x" * 300 + "7"
    forms = ["API_KEY={}", "API_KEY: {}", 'API_KEY="{}"', "api_key = '{}'", "https://h.example/p?token={}&x=1", "export A_TOKEN={}"]
    rows = [(i, f.format(v), "src/app") for v in (value, padded, far) for i, f in enumerate(forms)]
    found = secret_forest.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string"), []).withColumn("label", secret_forest.by_rule()).collect()
    assert sorted(r.candidate for r in found) == sorted([value, padded, far] * len(forms))
    assert all(r.named == 1 and r.assigned == 1 for r in found) and sum(r.label for r in found if r.candidate == value) == len(forms)


def test_rare_secrets_are_found_in_large_tables(spark):
    names = " ".join(f"release-of-the-library-{i:06d}" for i in range(25_000))
    secrets = [(i, f'token = "{i:04x}a86d081884c7d659a2feaa0c55ad{i:04x}" end', "src/app") for i in range(1, 4)]
    for text in ("nothing here", names):
        out = secret_forest.scanned(spark.createDataFrame([(0, text, "src/app"), (0, "see release-of-the-library-number-1", "src/app"), *secrets], "doc_id long, text string, source string"), words=[]).where("is_secret").collect()
        assert {r.doc_id for r in out} == {1, 2, 3}
    only = secret_forest.scanned(spark.createDataFrame(secrets, "doc_id long, text string, source string"), secret_forest.candidates(spark.createDataFrame([(0, names[:999], "a")], "doc_id long, text string, source string"), []).withColumn("label", F.lit(0.0)), [])
    assert only.where("is_secret").count() == 3


def test_samples_hold_rare_labels(spark):
    names = " ".join(f"release-of-the-library-{i:06d}" for i in range(3_000))
    docs = spark.createDataFrame([(0, names, "src/app"), (1, 'token = "9f86d081884c7d659a2feaa0c55ad015" end', "src/app")], "doc_id long, text string, source string")
    sample = secret_forest.rule_findings(secret_forest.candidates(docs, []), 20)
    assert {r[0]: r[1] for r in sample.groupBy("label").count().collect()} == {0.0: 10, 1.0: 1}
