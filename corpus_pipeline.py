"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to shared storage and read again as the
next stage's documents. All but the last return the columns of ``documents`` and whatever else came along.

Common to all stages: an empty table gives an empty table; extra columns pass through untouched, whatever their names;
nulls in other columns than ``doc_id`` and ``text`` change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm import decontaminate, jaccard, language, packing, pii
from palisade.llm.common import written

# Mean probability below which no language is accepted; with several languages chance alone gives about their share.
MIN_SCORE = 0.3
# Near duplicates: shingles of five words, similarity of 0.8 or more.
NEAR = jaccard.Rule(words=5, part=80, base=100)

# Keys of rows to drop that are sent to the texts; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no recognisable language: null, without letters, or classified below ``MIN_SCORE``.

    The network is trained on a bounded sample of the labelled documents. Where nothing is labelled nothing can be
    recognised, and only texts without letters are dropped. Equal rows are kept alike.
    """
    label, score = "__lang_pred", "__lang_score"
    net = language.fit(docs, ~language.held_out())
    if net is None:
        return docs.filter(F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)))
    found = language.predict(docs, net, lang_out=label, score_out=score)
    return found.filter((F.col(label) != language.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of similar documents the one with the smallest ``doc_id``.

    Groups are connected by links of similarity 0.8 or more, and of rows, for an id may repeat with other texts: such rows are
    told apart by their texts, and a row without an id comes last. Rows that repeat id and text are one document; texts
    without words are alone in their groups.
    """
    key = "__row_key"
    dropped = written(jaccard.repeated_rows(docs, NEAR).withColumnRenamed("key", key), "near-duplicates")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.withColumn(key, jaccard.row_key()).join(dropped, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within its error budget; null texts hold none."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole_words=True)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets and bring ``n_chars`` up to date; no document is dropped."""
    spans = "__personal_data"
    redacted = pii.redact(pii.find_personal_data(docs, out=spans), spans=spans)
    if "n_chars" in docs.columns:
        changed = (F.size(spans) > 0) & F.col("text").isNotNull()
        redacted = redacted.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return redacted.select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into token sequences; see :func:`palisade.llm.packing.pack_documents`."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

# The model of the first stage is trained, so SQL cannot state the rows; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
