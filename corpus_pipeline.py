"""The corpus pipeline: from raw documents to sampled piece ids.

Each stage works on all rows that the stage before it kept, and is written and
read again in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cowrie.llm import language, mixing, pieces, simhash, toxicity
from cowrie.llm.common import shared_dir

#: Most stages cannot be put in SQL; each is tested against a plain version of itself over the small tables.
ORACLE_SQL: str | None = None


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Documents whose further columns lie in one struct, where no operator's names can clash with theirs; and the way back."""
    own, rest = ("doc_id", "text", "lang", "source"), "cowrie_documents_rest"
    extra = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    held = docs.select(*own, *[F.struct(*extra).alias(rest)] * bool(extra))
    return held, lambda df: df.select(*[F.col(c) if c in own else F.col(f"{rest}.`{c}`").alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learned from ``labels``, does not call toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held, back = _apart(docs)
    return back(toxicity.score(held, model).where("predicted = 0"))


def reject_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a determined language that holds at least half of the telling words."""
    held, back = _apart(docs)
    return back(language.keeps(language.identify(held, language.fit(held), spans=False)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    held, back = _apart(docs)
    return back(simhash.deduplicate(held))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate says."""
    held, back = _apart(docs)
    return back(mixing.emit(mixing.mix(held)))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each row's text, as piece ids in ``samples``, in place of the text; copies of a row have samples of their own.

    A column ``samples`` of the documents gives way to it.
    """
    return pieces.encode(docs.drop("samples"), copies=True).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("language", reject_undetermined),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
