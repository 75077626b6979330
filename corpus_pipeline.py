"""A corpus from raw documents to token files, in five stages of training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partflow.llm import decontaminate, jaccard_join, mixing, quality, token_files
from partflow.llm.common import WORD, scratch, stored, table, without

#: Near duplicates: shingles of five words, similarity 0.8 or more.
NEAR = jaccard_join.Rule(n=5, num=80, den=100, n2=2, k2=1)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Rows with one doc_id are judged by the best of their texts; rows without a doc_id stay; a null text counts as empty and is judged as
    such; without labels of both kinds every row stays; equal rows share their fate; extra columns are kept."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays.

    Rows with one doc_id are one document, their links joined, and stay or go together; rows without a doc_id, text or words link with
    nothing and stay; an empty table gives no rows; extra columns are kept."""
    gone = jaccard_join.jaccard_classes(docs, NEAR).filter("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, gone)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    All rows of a doc_id go if one of them leaks; rows without a doc_id stay, as do null and empty texts; a benchmark without items drops
    nothing; equal rows share their fate; extra columns are kept."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def _whole_row(docs: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which Spark doesn't hash, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each whole pass over a document, and one with the words of its picked blocks if the last pass takes
    a part; documents of which nothing is taken go.

    Rows that are equal in all columns stand one after another on their source's line, each with an amount of its own: each of them gives
    its own rows, and together they hold as many words as the mix takes of them. Null, empty and wordless texts give nothing; null ids
    and sources take part as any other; an empty table gives no rows; extra columns are kept, whatever their names."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), _whole_row(docs).alias("_row"))  # apart from the plan's names
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    rows = rows.withColumn("_p", mixing.place(F.col("doc.doc_id"), text))
    sizes = stored(mixing.sized(docs, extra={"row": _whole_row(docs)}), "mix")
    plan = mixing.mix(sizes).filter("taken > 0").select(
        F.col("row").alias("_plan_row"), "place", "size", "start", "passes", "rest", "turn", "ring", "unit", "blocks", "picks", (F.col("taken") - F.col("passes") * F.col("size")).alias("part")
    )
    # equal rows are one here and as many as they were in the plan, so that the join gives each row of the plan once
    rows = rows.dropDuplicates(["_p", "_row"]).join(plan, (F.col("_row") == F.col("_plan_row")) & (F.col("_p") == F.col("place")))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def picked(_, i):
        return mixing.rest_takes(F.col("start") + i)

    part = F.when(F.col("part") == F.col("size"), text).otherwise(F.array_join(F.filter(words, picked), " "))
    copies = F.concat(F.array_repeat(text, F.col("passes").cast("int")), F.when(F.col("part") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = rows.withColumn("_text", F.explode(copies))
    kinds = dict(docs.dtypes)
    new = {"text": F.col("_text"), "n_chars": F.length("_text")}
    return out.select(*[new.get(c, F.col("doc")[c]).cast(kinds[c]).alias(c) for c in docs.columns])


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32.

    A row of the mix is a document of its own, so a doc_id of which several passes are taken comes several times; a null doc_id is
    written first; an empty text is its end alone; an empty table gives no rows."""
    return token_files.read_token_files(token_files.write_token_files(docs, scratch(spark, "corpus"), token_files.tokenizer_path()))


STAGES = [
    ("quality", drop_poor),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: Training, set similarity and tokenization aren't SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
