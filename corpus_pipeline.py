"""A corpus pipeline over ``documents``: five stages, each an operator of ``kinoflow.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again as the
next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoflow.llm import decontaminate, language_id, line_dedup, near_dedup, sentencepiece_viterbi
from kinoflow.llm.common import kept, passing, shared_dir
from kinoflow.llm.queries import table, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LANGUAGES = ("de", "en", "es", "fr")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in one of LANGUAGES with a posterior of at least one half.

    ``lang`` labels the sample on which the model is fitted; it isn't evidence on a row's own language too. Null or
    empty texts and those without letters go: nothing says what language they are in. Repeated rows share their fate;
    a null source leaves the prior of all rows; ties go to the first language by name; empty table: no rows.
    """
    found = language_id.identify(docs, language_id.fit(docs), host_col="source", accept=LANGUAGES, least=0.5)
    return found.where("accepted").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines of 40 or more characters that 5 or more rows hold, but in the row of the largest id; n_chars
    follows the text where it changes.

    Every row stays, if only with an empty text. Null texts stay null. Rows of one id each count; a null id counts but
    keeps nothing that another holds. Empty table: no rows.
    """
    out = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: similarity 0.8 of five-word shingles, or more.

    It is the row of the group's smallest id; of several rows of that id the one with the smallest text. Texts without
    words are no copies of one another: their rows stay, also several of one id, and so do rows of a null id. Empty
    table: no rows.
    """
    found = near_dedup.near_duplicates(docs, shingle=5, percent=80)
    per = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("first"), F.count_if(F.col("n_shingles") > 0).alias("n"))
    decided = kept(per.where("not first or n > 1"), "near-copies")  # so the operator's plan runs once
    gone = decided.where("not first").select(F.col("doc_id").alias("gone"))
    rest = docs.select(COLUMNS).join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    several = decided.where("first and n > 1").select(F.col("doc_id").alias("several"))
    if several.isEmpty():
        return rest
    worded = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    once = rest.join(several, (F.col("doc_id") == F.col("several")) & worded, "left_anti")
    first = rest.where(worded).join(several, F.col("doc_id") == F.col("several"), "left_semi")  # texts of repeated ids alone
    first = first.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return once.unionByName(first).select(COLUMNS)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of 13 words of a benchmark item, or a whole shorter item, whatever share of
    the document it is: a passage in a long text leaks as much as one in a short text.

    Null and empty texts hold none and stay, so do rows of a null id. Rows of one id go together. No items, or empty
    tables: nothing goes.
    """
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where("n_hit > 0").select(F.col("doc_id").alias("gone")).distinct()
    return docs.select(COLUMNS).join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's piece ids, and whether decoding gives the text back; one row a row.

    Null or empty texts have no ids and are exact. Splits of equal sums: the longer last piece. Repeated rows each
    come back. Empty table: no rows.
    """
    pieces = sentencepiece_viterbi.Pieces.load(tokenizer_file("piece_bpe_32k.model"))
    done = sentencepiece_viterbi.round_trip(docs, pieces)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")


STAGES = [
    ("language ID", keep_languages),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_copies),
    ("SentencePiece encoding", encode_pieces),
]

#: Perfect hashes, MinHash components and Viterbi can't be put in SQL that runs on whole tables; tests hold run()
#: against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each writes is removed when the driver's JVM ends."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    passing(spark, folder)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
