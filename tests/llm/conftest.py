import random

import pytest

#: Columns with names that operators use inside, or return.
CLASHES = {
    "fp": 1, "text_key": 2, "kept": 3, "score": 4, "lang_pred": 5, "h": 6, "n": 7, "unit": 8, "batch": 9, "rank": 10,
    "component_id": 11, "held_out": 12, "digest": 13, "bucket": 14, "low": 15, "words": 16, "removed": 17, "mark": 18,
}
BASE = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMA = BASE + "".join(f", {c} int" for c in CLASHES)
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box under silver moons near old stone towers".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "."]) for _ in range(n))


def rows():
    """Copies, nulls everywhere, empty and long texts, repeated rows, texts without words or letters."""
    long = prose(1, 60_000)
    texts = [
        (1, prose(2, 40)),
        (2, prose(2, 40)),
        (3, prose(2, 40).upper()),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b\x0c\r "),
        (7, "1234 5678 !!!"),
        (8, "Élan çà été, größer straße. Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich"),
        (9, long),
        (10, long),
        (10, long),
        (11, prose(3, 30) + ". Licensed under the Apache License, Version 2.0."),
        (12, "mit license MIT License apache license general public license"),
        (13, "word"),
        (14, "日本語のテキスト　全角 𝒳𝒴 👩‍👩‍👧"),
        (None, "an orphan without an id stays what it is"),
        (None, "an orphan without an id stays what it is"),
        (None, None),
        (-100, prose(4, 20)),
    ]
    return [(i, t, None if i == 2 else "en" if i is None or i % 3 else "de", None, None, *CLASHES.values()) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
