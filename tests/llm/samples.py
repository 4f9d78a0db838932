"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

import os
import re

import duckdb

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} is number {i} of a very long text." for i in range(20_000))
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, gone int, n_lines string, "
    "kept string, rank int, score string, batch int, bucket string"
)


def awkward(spark):
    """Rows of (doc_id, text) with every other column null or set, all names that operators use inside."""
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, LONG), (5, "Only three words"), (6, "!!! ??? 123"),
        (7, "one line that is long enough to count\nshort\none line that is long enough to count"),
        (8, "One line that is LONG enough to count  \nother text of document eight goes here for good"),
        (9, "\tone line that is long enough to count\r\nand another text of document nine, for good"),
        (9, "\tone line that is long enough to count\r\nand another text of document nine, for good"),
        (None, "a text without an id\none line that is long enough to count"), (None, None),
        (10, "ünïcödé wörds ärë hërë tö stäy för gööd \U0001f600 <|endoftext|>  two  spaces \n x"), (11, LONG + " tail"),
    ]
    full = [(d, t, "en" if i % 3 else None, None, None, "r", i, None, "k", i, "s", None, "b") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(folder=SMALL):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{folder}/documents.parquet'").fetchall()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text or ""))


def shingles(text, k=5):
    own = words(text)
    return {tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def root():
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
