"""A training corpus from raw documents: five stages, each written and read again.

language: texts without a letter go, and those for which the network finds no label likelier than not;
near_duplicates: one document of each group of near copies stays; pii: personal numbers and addresses get pseudonyms;
mix: sources are repeated to their target weights; pack: the texts are packed into sequences of 4096 tokens.

doc_id is taken as the key of documents.  Rows of a null id stay in every stage.  Other columns than those of
documents go, whatever their names; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.llm import jaccard_join, language_id, mixing, packing, pseudonyms
from barograph.llm.entries import DEMO_KEY, vocabulary
from barograph.llm.shared import forget, maybe, saved, table, without, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least probability of the likeliest language: more than all others together.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network gives a language by more than ``LEAST_SCORE``; their own label stays as it is.

    Null texts and texts without a letter have none and go.  Where no labelled row can be learned from, all have none;
    then only texts without a letter go.  Repeated rows and rows of null id are judged one by one.
    """
    found = language_id.identify(docs, language_id.fold(F.col("doc_id")) == 2, keep=COLUMNS)
    unlearned = found.where(F.col("lang_pred") != language_id.UND).isEmpty()
    kept = F.col("text").rlike("\\p{L}") if unlearned else (F.col("lang_pred") != language_id.UND) & (F.col("score") > LEAST_SCORE)
    return found.where(kept).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word 5-grams, Jaccard similarity 0.8 or more: the smallest doc_id of each group stays, and its rows of equal text once.

    Null and empty texts have no near copies and stay, as do rows of null id.  Rows that repeat an id with another
    text stay or go together with the id's greatest text.
    """
    docs = docs.select(*COLUMNS)
    groups = saved(jaccard_join.jaccard_groups(docs, 5, 80, 100).where("doc_id is not null"), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id")
    again = saved(groups.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "again")
    kept = without(docs, gone)
    if again.isEmpty():
        return kept
    # only rows of repeated ids are compared by their texts
    several = maybe(kept, again).join(again, "doc_id", "left_semi").select(*COLUMNS)
    columns = [F.min(F.struct(*(c for c in COLUMNS if c not in ("doc_id", "text")))).alias("rest")]
    once = several.groupBy("doc_id", "text").agg(*columns).select("doc_id", "text", "rest.*")
    return without(kept, again).unionByName(once.select(*COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with pseudonyms in its text and n_chars anew; null text stays null, with null n_chars."""
    out = pseudonyms.pseudonymize(docs.select(*COLUMNS), DEMO_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks for; rows that the mix leaves out, and those without a word, go."""
    counted = mixing.mix(docs, mixing.cyclic_weights(3), 3, keep=COLUMNS)
    times = (F.col("taken") / F.col("size")).cast("int")
    taken = counted.where("taken > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    return taken.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of each row's text, with its sequence and place; null and empty texts have their closing id."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 4096, 1)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("pii", pii), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on documents; what a stage has written for itself goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = written()
        result = stage(spark, docs, sf_dir)
        inside = written() - before
        docs = saved(result, f"stage-{name}")
        forget(inside)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier, seeded samples and a tokenizer stand between documents and the result.
ORACLE_SQL = None
