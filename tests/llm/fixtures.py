"""Small documents with the awkward cases, and plain models of what operators share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row string, id int, k1 string, n string"

BASE = " ".join(f"word{i} alpha{i % 7} beta{i % 5}" for i in range(60))
LONG = "\n".join(f"line {i} of a long text that says {i * i} and {i % 13}" for i in range(3000))

TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("word30", "changed")), (4, "Other words entirely, " * 3), (5, ""), (6, None), (7, "   \n\t "),
    (8, "one two"), (9, "One TWO"), (10, "Über\nÜber\nder Fluß\nÜber\nder Fluß"), (11, LONG), (11, LONG), (None, "text without an id " * 4), (None, None),
    (12, "first line here\nsecond line here\nthird"), (13, "x\nfirst line here\nsecond line here\n\n"), (14, "first line here\n\nsecond line here\nthird\nfourth"),
]


def documents(spark, texts=None):
    rows = [(i, t, "r", 5, "k", None) for i, t in (TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA)
