"""From raw documents to packed training sequences, in five stages.

Every stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the docs of the next one. All but the last return
the columns of documents.

Cases, by stage (long texts are whole rows in all of them, and an empty table
stays empty):

* toxicity: null and empty texts are scored and stay if the model has them
  below 0.5; rows are judged one by one, equal texts alike.
* ngram_jaccard_join: the row with the smallest doc_id of a class stays, null
  ids last; of rows equal in doc_id and text one stays; rows without words all
  stay.
* secret_scan: all rows stay; a null text stays null; n_chars follows a text
  that is masked.
* mix_sources: rows without words are not taken; a null source is a source of
  its own; a document may be taken twice.
* best_fit_packing: every taken copy is packed as a row of its own.

Extra columns pass through up to the last stage, under the operators' rules for
names that clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenclia.llm import mixing, ngram_join, packing, secrets, toxicity
from nomenclia.llm.common import few, keyed, stage, table
from nomenclia.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of the fold that op4 trains on."""
    labels = table(spark, sf_dir, "labels").where(toxicity.fold() != 0)
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    # The score is the text's alone, so texts go to Python and their digests come back.
    texts = keyed(docs.select("text"), "text")
    toxic = stage(toxicity.score(texts, model, ["__k1", "__k2"]).where("predicted = 1").select("__k1", "__k2").distinct(), "toxic")
    return keyed(docs, "text").join(few(toxic), ["__k1", "__k2"], "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (runs of five words, similarity 0.75)."""
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text masked."""
    found = secrets.scan(docs)
    text = secrets.masked(F.col("text"), F.col("all_spans"))
    changed = F.size("all_spans") > 0
    return found.withColumn("__text", text).select(*[F.col("__text").alias(c) if c == "text" else F.when(changed, F.length("__text")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, in training order."""
    return mixing.training_order(mixing.mix(docs)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset; a smaller memo, as earlier stages' memory is still held."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), memo=100_000))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the near-copy classes and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
