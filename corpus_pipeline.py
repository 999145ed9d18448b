"""A corpus pipeline over ``documents``: five stages, each an operator of keyline.llm.

Every stage takes the rows its predecessor kept and returns the columns of
``documents``, but for the last, which returns the index of the written token ids.
Stages are written as Parquet to the shared folder and read again, so a lost executor
costs one stage's tasks and no stage is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyline.llm import decontam, langid, mixing, ngram_join, queries, tokens
from keyline.llm.storage import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Phrases per symbol above which a text is in none of the learned languages. On sf0.1
#: texts of 50 characters and more have 0.37 at most, mostly 0.2; Italian, which is not
#: learned there, has 0.43, Finnish, Polish, Turkish and Hungarian 0.52 to 0.57.
MAX_PHRASE_RATE = 0.4
#: Shorter texts, by letters: a secret among few words raises the rate (0.43 on check_s),
#: so up to 100 letters it may be 0.5. Below 40 they say too little, and the limit only
#: rejects foreign script; a single letter has to be one the model knows.
LETTERS, MAX_MIDDLE_RATE, SHORT_LETTERS, MAX_SHORT_RATE = 100, 0.5, 40, 0.8


def in_learned_language(model: langid.Model, *, text: str = "text") -> Column:
    """Whether a row of ``langid.predict`` holds text in a language of the model."""
    def at_least(letters: int) -> Column:
        return F.col(text).rlike(rf"(?:\p{{L}}[^\p{{L}}]*+){{{letters}}}")

    single = F.col(text).rlike(r"\A[^\p{L}]*+\p{L}[^\p{L}]*+\z")
    letter = F.lower(F.regexp_extract(text, r"(\p{L})", 1))
    limit = F.when(at_least(LETTERS), MAX_PHRASE_RATE).when(at_least(SHORT_LETTERS), MAX_MIDDLE_RATE)
    limit = limit.otherwise(MAX_SHORT_RATE)
    fits = F.when(single, F.contains(F.lit(model.letters), letter)).otherwise(F.col("phrase_rate") <= limit)
    return (F.col("lang_pred") != langid.UNKNOWN) & fits


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters and those in no language that the labels name."""
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).filter(in_learned_language(model)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of linked documents: that of the least id.

    Rows are told apart by their texts, so different texts that repeat an id, or have
    none, each count for themselves.
    """
    return ngram_join.drop_linked(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents to meet the weights of their sources, in a global shuffle."""
    return mixing.mix(docs, queries.MIX_WEIGHTS, seed=queries.MIX_SEED, told_by=["text"], keep_marks=False)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token ids in the order in which the shuffle left the rows, and return the
    index of the files: doc_id, start, n_tokens, ids_crc32."""
    return tokens.tokenize_to_table(docs, queries.tokenizer_path(), end_id=queries.END_ID, by_key=False)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mix_sources", mix_sources),
    ("token_ids", write_tokens),
]

#: Greedy string tiling, language models and tokenizers can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the index of the written token ids."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
