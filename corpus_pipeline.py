"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
returns a DataFrame; all but the last return the columns of ``documents``. The
secrets and near copies that a stage decides on are gone from its result. Null ids and
null texts are kept by every stage but where the classifier rejects them; other columns
stay as they are, whatever their names; n_chars, where it is, follows the text; an empty
table stays empty. Of equal texts under one id one row stays; unlike texts under one id
are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.workspace import Workspace
from tidewright.llm import line_dedup, packing, quality, secrets
from tidewright.llm.columns import numbered
from tidewright.llm.jaccard_join import without_near_copies

#: A factorisation machine is fitted and similarities are found by components: not for SQL.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """The rows with n_chars as the text now is."""
    rows, (text,) = numbered(docs, "text")
    length = lambda kind: F.char_length(F.col(text).cast("string")).cast(kind)
    return rows.select(*[(length(kind) if c == "n_chars" else F.col(f"c{i}")).alias(c) for i, (c, kind) in enumerate(docs.dtypes)])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have, but for the marks by which the secret scans know a private key."""
    return _counted(line_dedup.without_common_lines(docs, spare=secrets.KEY_MARK))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of five-word shingles, at a similarity of 0.8 or more, connect."""
    return without_near_copies(docs, width=5, threshold=(4, 5))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret span replaced by a mark."""
    return _counted(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline"), None
    for name, stage in STAGES:
        with Workspace.scope():
            docs = work.keep(name.replace(" ", "-"), stage(spark, docs, sf_dir))
        if before:
            work.drop(before)
        before = name.replace(" ", "-")
    return docs
