"""Small tables with the awkward rows that every operator has to take."""

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def awkward(spark, schema_extra: str = ""):
    """Documents with nulls in any column, empty and long texts, repeats, and columns with clashing names."""
    shared = prose(99, 60)
    rows = [
        (1, prose(1, 80) + "\n" + shared, "en", "a", 5),
        (2, shared + "  \t" + prose(2, 40), "en", "a", None),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "de", "b", 3),
        (6, prose(1, 80) + "\n" + shared, "en", None, 5),
        (7, "Ein kurzer Text", "de", "b", 15),
        (8, "Ein kurzer Text", "de", "b", 15),
        (9, prose(3, 30_000, 30_000), "fr", "c", 9),
        (None, "no id here but words enough to count for something more", "en", "a", 1),
        (10, "123 456 ???", None, "a", 11),
        (10, "123 456 ???", None, "a", 11),
    ]
    rows = [(*r, 7, 0.5, "x", 1, "y") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, kept_text string, size int, component_id string")


def empty(spark):
    return awkward(spark).limit(0)
