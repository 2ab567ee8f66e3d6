"""A corpus pipeline over ``documents``: language, near copies, repeated passages, mix, pieces.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but
the last return the columns of ``docs`` with their values: what a stage adds has names that
``docs`` hasn't, and goes before the stage ends.  The stages have no caps and no state besides
what they write to the shared folder.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm.common import contents, fresh, table, written
from ledgerframe.llm.language_id import UNKNOWN, identify, learn
from ledgerframe.llm.minhash_dedup import near_duplicates
from ledgerframe.llm.mixing import dealt
from ledgerframe.llm.sentencepieces import MODEL, Pieces, encode_pieces
from ledgerframe.llm.substring_dedup import dedup_substrings


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go (null and empty texts too); ``lang`` becomes the predicted one."""
    name = fresh("lang_pred", docs.columns)
    found = identify(docs, learn(docs), keep=True, names=(name, fresh("score", docs.columns))).where(F.col(name) != UNKNOWN)
    return found.withColumn("lang", F.col(name)).select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a similarity of 0.8 or more) the document with the smallest id stays.

    Of rows equal in id and text one stays; different texts under one id are documents of their
    own, the smaller hash first.  A null id counts as an id of its own for every
    text, below all others.
    """
    text = F.coalesce("text", F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64(text), 2))
    node = fresh("_id", docs.columns)
    content = [fresh(f"_content{k}", docs.columns) for k in range(2)]
    keyed = docs.withColumns({node: own, **dict(zip(content, contents(text)))})
    kept = near_duplicates(keyed, id_col=node, by_row=True).where("kept").select("doc_id", "content", "content2").distinct()
    names = [f"{n}_kept" for n in (node, *content)]
    kept = kept.toDF(*[fresh(n, keyed.columns) for n in names])
    same = [F.col(a) == F.col(b) for a, b in zip((node, *content), kept.columns)]
    stay = keyed.join(kept, same, "left_semi")
    return stay.dropDuplicates([node, *content]).select(*_columns(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; the other words are joined by one space.

    Every row stays, with an empty text if nothing is left; ``n_chars`` follows the text.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = dedup_substrings(docs, carry=others)
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), **{c: F.col("rest")[c] for c in others}}
    if "n_chars" in others:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, dealt out to shards and shuffled within them."""
    return dealt(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document with its piece ids and their number."""
    return encode_pieces(docs, Pieces.load(model))


STAGES = [("language_id", language), ("minhash_dedup", near_copies), ("substring_dedup", passages), ("source_mixing", mix), ("sentencepieces", pieces)]

#: Neither a learned language nor a seeded segmentation can be put in SQL; tests hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    steps = [functools.partial(stage, spark, sf_dir=sf_dir) for _, stage in STAGES]
    for step in steps[:-1]:
        docs = written(step(docs=docs), "stage")
    return steps[-1](docs=docs)
