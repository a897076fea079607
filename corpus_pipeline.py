"""From raw documents to token ids: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm import curriculum, jaccard_join, language_id, pieces, surrogates
from fleetspark.llm.components import new_stage, shared_folder
from fleetspark.llm.queries import PIECES_MODEL
from fleetspark.session import materialize


def _numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs with a number that rises with the written files and the rows in them.

    It is read from the files' names and the rows' places, so it is the same
    in each evaluation however the scan is split.  Rows that come from no file
    are written first.
    """
    try:
        named = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    # part-00012-....c003.snappy.parquet: the task's number, and that of its file
    part, file = F.regexp_extract("_file", r"^part-(\d+)", 1), F.regexp_extract("_file", r"[.-]c(\d+)\.", 1)
    number = lambda c: F.coalesce(F.expr(f"try_cast(nullif({c}, '') AS BIGINT)"), F.lit(0))
    named = named.withColumns({"_part": part, "_number": file})
    place = F.shiftleft(number("_part"), 44) + F.shiftleft(number("_number"), 34) + F.col("_at")
    return named.withColumn(name, place).drop("_file", "_at", "_part", "_number")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects; unlabelled ones get the language found.

    The models learn from the labels of docs.  Null texts and texts without a
    letter are rejected.
    """
    new_stage(spark)
    model = language_id.train(docs, F.lit(True))
    kept = language_id.identify(docs, model).where("NOT rejected")
    return kept.select(*[F.coalesce("doc.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"doc.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at 80 percent of five-word shingles: the least doc_id, null last.

    Of repeated rows one stays too.  Rows are told apart by their place in the
    files that the stage before has written, which no split of the scan changes.
    Null and empty texts are linked with nothing and stay.
    """
    new_stage(spark)
    keyed = _numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row")
    groups = jaccard_join.similar_documents(keyed.select(key.alias("key"), "text"), words=5, percent=80, id_column="key")
    first = groups.where("key = component_id").select("key._row")
    return keyed.join(first, "_row", "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars follows the text.

    Null texts stay null with null n_chars; repeated rows are rewritten alike.
    """
    new_stage(spark)
    out = surrogates.replaced(docs, carry=[c for c in docs.columns if c != "text"])
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents to their sources' targets, each pass a row, in training order.

    The rows are written in ranges of their position: the files' numbers and the
    rows' places in them are that order.  Texts without a word are not taken.
    """
    new_stage(spark)
    return curriculum.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document; position ascends in training order.

    Null and empty texts have no ids; repeated rows are passes of the mix.
    """
    new_stage(spark)
    out = pieces.encoded(_numbered(docs, "position"), PIECES_MODEL, ["doc_id", "lang", "source", "position"])
    return out.select("doc.*", "n_tokens", "round_trip", "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

#: The stages learn models, draw surrogates and cut texts in pieces, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what stands between two stages lies in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
