"""Small tables with every awkward case, and helpers."""

import hashlib
import zlib

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the farm today"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the farm today"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the farm today"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "one"),
    (7, "ONE"),
    (8, "12345 !!! ???"),
    (9, LONG),
    (None, "no id here but a text of a few words"),
    (None, None),
    (10, "déjà vu été naïve façade 日本語 текст"),
    (11, "\x85   odd spaces"),
    (11, "the same id with another text"),
    (12, "a" * 5000),
]
SCHEMA = "doc_id long, text string"
#: Extra columns whose names the operators use inside.
CLASH = ["score", "lang_pred", "n_tokens", "weight", "pid", "key", "cls", "bands", "text_key", "item_ids", "similarity", "_spans", "_postings", "source_", "place_", "n_copies", "held_out", "found_key", "k1", "m", "start"]


def frame(spark, rows=TEXTS, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("x").alias(c) for c in CLASH])
    return df


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def low(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
