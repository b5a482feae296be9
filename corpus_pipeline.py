"""From raw documents to packed training sequences, in five stages on whole tables.

Each stage takes (spark, docs, sf_dir) and returns a frame; its result is written as Parquet and
read again as the next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, phrases, pii, probminhash, toxicity
from tessera.llm.common import shared_folder, spare, table

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7; null and empty texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = spare(docs.columns, "toxicity")
    scored = toxicity.score(docs, model, docs.columns, out=score)
    return scored.filter(F.col(score) < TOXIC).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class, and of rows that agree in id and text one; rows without
    an id stay.  A row goes by its own text: other rows of its id stay where theirs differ."""
    mark = spare(docs.columns, "mark")
    hashed = docs.withColumn(mark, F.xxhash64("text"))
    classes = probminhash.near_duplicates(hashed, mark=mark)
    gone = classes.filter("class_id <> doc_id").select("doc_id", mark).distinct()
    # Ids and hashes only; tables without repeated rows have none of these.
    again = classes.filter("doc_id IS NOT NULL").groupBy("doc_id", mark).count().filter("count > 1").select("doc_id", mark)
    rest = hashed.join(gone, ["doc_id", mark], "left_anti")
    if again.isEmpty():
        return rest.select(*docs.columns)
    once = rest.join(again, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return rest.join(again, ["doc_id", mark], "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def _free_prefix(docs: DataFrame) -> str:
    """A beginning that no column's name has."""
    prefix = "made_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that earlier documents hold in runs of 20; the words that stay are
    joined by one space.  Texts that lose nothing stay as they are."""
    made = _free_prefix(docs)
    out = phrases.remove_repeats(docs, keep=[c for c in docs.columns if c != "doc_id"], prefix=made)
    text = F.when(F.col(f"{made}n_removed") > 0, F.col(f"{made}kept")).otherwise(F.col("text"))
    return _with_text(out.withColumn("text", text), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data, and every secret, as its kind in brackets."""
    made = _free_prefix(docs)
    found = pii.find(docs, pii.train(docs), redact=True, keep=[c for c in docs.columns if c != "doc_id"], prefix=made)
    return _with_text(found.withColumn("text", F.col(f"{made}redacted")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs)


def _with_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the length of the new text where there is such a column."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.length("text").cast(kind))
    return changed.select(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

# Learnt scores and the tokenizer are beyond SQL; a brute-force version in the tests stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
