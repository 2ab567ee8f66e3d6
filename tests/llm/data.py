"""Small fixtures and brute-force versions."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns of documents, and some whose names clash with what operators add or use inside.
CLASHING = ["size", "target", "taken", "copies", "places", "node", "content", "kept", "component_id", "score", "lang_pred", "held_out", "ids", "n_tokens", "n_words", "rest", "features", "label", "path", "whole", "ends", "picked", "_hash", "_size", "_source", "_id", "_content", "_content0", "_text", "_key", "_mix", "_at", "source_size", "bits", "blocks", "ca", "cb", "old", "bucket"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def edge_rows(seed=1):
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies near and exact."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéß") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(60)
    near = base.split()
    near[50] = "changed"
    texts = [
        None, "", "   \n\t \x0b", "word", "two words", "Zwei WÖRTER", base, base, base.upper(), " ".join(near), prose(80) + "\n" + passage + "\n" + prose(30), passage + " " + prose(90),
        prose(30_000), "x" * 200_000, "line one two three\n" * 40, "▁   mid dle 漢字😀 \r\n\ttab", "licensed under the MIT License and the Apache  License, Version 2.0", "!!! ??? 123", "the the the the the",
    ]
    rows = []
    for i, text in enumerate(texts):
        rows.append((i, text, ["en", "de", None][i % 3], ["s1", "S2", None, "ä"][i % 4], None if text is None else len(text)))
    rows.append(rows[6])
    rows.append((None, "a text whose id is null " + prose(40), None, None, None))
    rows.append((None, None, None, None, None))
    rows += [(100 + i, prose(rng.randint(5, 90)), rng.choice(["en", "de"]), rng.choice(["s1", "S2"]), 7) for i in range(40)]
    return [(*r, *(None if j % 2 else "clash" for j in range(len(CLASHING)))) for r in rows]


def edge_docs(spark, parts=3):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(parts, "doc_id")


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
