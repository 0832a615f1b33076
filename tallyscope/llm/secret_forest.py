"""Secret scans: a random forest removes false positives from candidates.

A candidate is a run of 16 or more letters, digits and ``+/_=-`` with at least
one digit; of ``NAME=value`` the value, if it is such a run by itself, with the
name among what is before it.  Its statistics are column expressions: length, changes between
character classes, digits, distinct characters, coverage by the corpus's own
frequent words, its path (the source) and the words beside it.  The forest is
trained on labelled findings and applied to every candidate.

``rule_findings`` labels the candidates when no labelled findings are given:
assignments of long hexadecimal or mixed strings to a secret-like name count
as secrets, other candidates do not.  The forest is trained on a bounded sample
of each label by hash, weighted so that both labels count alike: secrets are
learned however rare they are.  With one label only, nothing is learned and
every candidate is judged by that rule (all are kept without findings).

Null texts have no candidates, null paths are empty; every occurrence is a row,
also in repeated rows; columns other than ``doc_id, text, source`` are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.rows import materialize
from tallyscope.llm.common import words_of

#: Groups: the name with its ``=``, if any, and the candidate.
CANDIDATE = (r"(?<![\p{L}\p{N}+/_=-])(?=[A-Za-z0-9+/_=-]{16})((?:[A-Za-z0-9+/_-]*+=++(?=[A-Za-z0-9+/_-]))?)"
             r"((?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,})(?![\p{L}\p{N}])")
NAMES = r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|auth|bearer|credential|access[_-]?key)"
#: Bound of the findings that the forest is trained on: half of it for each label, by hash.
FIT_ROWS = 20_000
DICTIONARY_WORDS = 300
TREES, DEPTH, SEED = 20, 6, 7
FEATURES = ("length", "class_changes", "digit_share", "upper_share", "distinct_share", "is_hex", "covered", "named", "assigned", "quoted", "near_digits", "path_length", "path_test")


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The corpus's most frequent words of three letters or more (lower-case ASCII), counted over all rows."""
    words = docs.select(F.explode(words_of(F.lower("text"))).alias("w")).where(F.col("w").rlike("^[a-z]{3,}$"))
    return [r[0] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def candidates(docs: DataFrame, words: list[str]) -> DataFrame:
    """A row per candidate with its statistics."""
    parts = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("path"), "text").where(F.col("text").rlike(CANDIDATE))
    pairs = parts.select("doc_id", "path", F.split("text", CANDIDATE, -1).alias("around"),
        F.arrays_zip(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(2)).alias("value")).alias("found"))
    rows = pairs.select("doc_id", "path", "around", F.posexplode("found").alias("place", "found")).select(
        "doc_id", "path", "place", F.col("found.value").alias("candidate"), F.concat(F.right(F.get("around", "place"), F.lit(40)), "found.name").alias("before"), F.left(F.get("around", F.col("place") + 1), F.lit(40)).alias("after"))
    c, size = F.col("candidate"), F.char_length("candidate")
    changes = F.regexp_count(c, F.lit(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[+/_=-])[^+/_=-]"))
    covered = F.lit(0) if not words else size - F.char_length(F.regexp_replace(F.lower(c), "|".join(sorted(words, key=len, reverse=True)), ""))
    number = lambda test: test.cast("double")
    return rows.select(
        "doc_id", "path", "place", "candidate", "before", "after", number(size).alias("length"), (changes / size).alias("class_changes"), (F.regexp_count(c, F.lit("[0-9]")) / size).alias("digit_share"),
        (F.regexp_count(c, F.lit("[A-Z]")) / size).alias("upper_share"), (F.size(F.array_distinct(F.split(c, ""))) / size).alias("distinct_share"), number(c.rlike("^[0-9a-fA-F]+$")).alias("is_hex"),
        (covered / size).alias("covered"), number(F.col("before").rlike(NAMES)).alias("named"), number(F.col("before").rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        number(F.col("before").rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")).alias("quoted"), number(F.regexp_count(F.concat("before", "after"), F.lit("[0-9]"))).alias("near_digits"),
        number(F.char_length("path")).alias("path_length"), number(F.col("path").rlike("(?i)test|example|sample|mock|fixture")).alias("path_test"))


def by_rule() -> Column:
    """Label of a candidate by form and neighbours alone."""
    strong = (F.col("is_hex") == 1) & (F.col("length") >= 32) | (F.col("class_changes") >= 0.15) & (F.col("length") >= 20)
    return ((F.col("named") == 1) & (F.col("assigned") == 1) & strong & (F.col("path_test") == 0)).cast("double")


def _sampled(findings: DataFrame, rows: int) -> DataFrame:
    """At most half of ``rows`` findings of each label, by hash; tasks keep no more than that before the shuffle."""
    keys = [c for c in ("doc_id", "place", "candidate", *FEATURES) if c in findings.columns]
    order = Window.partitionBy("label").orderBy(F.xxhash64(*keys), *keys)
    return findings.where("label IS NOT NULL").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows // 2).drop("_rank")


def rule_findings(found: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most half of ``rows`` candidates of each label by rule."""
    return _sampled(found.withColumn("label", by_rule()), rows)


def train(findings: DataFrame, rows: int = FIT_ROWS):
    """A forest from labelled findings (the features and ``label``), or the only label there is (None: no finding)."""
    sample = materialize(_sampled(findings, rows).select(F.col("label").cast("double").alias("label"), *FEATURES), "findings")
    counts = dict(sample.groupBy("label").count().collect())
    if len(counts) < 2:
        return next(iter(counts), None)
    total = sum(counts.values())
    weight = F.lit(0.0)
    for label, n in sorted(counts.items()):
        weight = F.when(F.col("label") == label, total / (len(counts) * n)).otherwise(weight)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(sample.withColumn("weight", weight))


def scanned(docs: DataFrame, findings: DataFrame | None = None, words: list[str] | None = None) -> DataFrame:
    """``doc_id, place, candidate, probability, is_secret`` for every candidate of ``docs(doc_id, text, source)``."""
    words = dictionary(docs) if words is None else words
    found = candidates(docs, words)
    model = train(found.withColumn("label", by_rule()) if findings is None else findings)
    if model is None or isinstance(model, float):
        scored = found.withColumn("probability", F.lit(1.0) if model is None else by_rule())
    else:
        scored = model.transform(found).withColumn("probability", F.element_at(vector_to_array("probability"), 2))
    return scored.select("doc_id", F.col("place").cast("bigint").alias("place"), "candidate", "probability", (F.col("probability") >= 0.5).alias("is_secret"))
