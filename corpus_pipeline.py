"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, so that a stage's Parquet is the next
one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import decontam, langid, mixing
from ledgerloom.llm.common import table
from ledgerloom.llm.ngram_join import one_of_each
from ledgerloom.llm.registry import vocabulary
from ledgerloom.llm.token_binary import token_binary
from ledgerloom.storage import stored


#: Languages that stay, as the labels name them; None: every learned one.
LANGUAGES: set[str] | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the identifier finds in a wanted language, and note that language in ``lang``.

    Rejected: null, empty and letterless texts (``und``), and texts that are no
    likelier in the predicted language than noise is, as those in a language never
    learned; with ``LANGUAGES`` also those of other languages. Ids and sources may
    be null, repeated rows all stay or all go, and nothing stays where no row
    has a language to learn from.
    """
    found = langid.identify(docs, langid.train(docs))
    answer = found[found.columns[-1]]
    found = found.where((answer["lang_pred"] != "und") & (answer["score"] > 0))
    if LANGUAGES is not None:
        found = found.where(answer["lang_pred"].isin(sorted(LANGUAGES)))
    return found.select(*(answer["lang_pred"].alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of linked texts: the one with the least doc_id, a null id last.

    Of repeated rows one stays; null, empty and blank texts link with nothing and all stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item; the text alone decides, so copies go together.

    Null and empty texts leak nothing and stay, as does everything if the benchmark is empty.
    """
    found = decontam.leaks(docs, table(spark, sf_dir, "benchmark")).select("text_hash").distinct()
    return docs.join(found, F.xxhash64(docs["text"]) == found["text_hash"], "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each draw, so a document may come twice, in the order of the shuffled shards.

    A null source is the last one; null and blank texts have no words and are
    drawn with their block; repeated rows are drawn together. Columns that the mix
    would name alike keep their values.
    """
    return mixing.drawn(mixing.mix(docs)).select(*(F.col(f"`{c}`") for c in docs.columns))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all drawn documents in compressed planes, in ascending doc_id order, read back as their digest.

    A null or empty text has only the end id, null ids come first, each repeated row
    counts, and other columns are left behind.
    """
    return token_binary(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_files", token_files),
]

#: Trained models, seeded draws and tokenizers have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    df = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i + 1 < len(STAGES):
            df = stored(df, f"stage-{name}")
    return df
