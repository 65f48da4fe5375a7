import random

import pytest

#: Names that operators use inside; as extra columns they must not matter.
CLASHES = ("row", "size", "target", "source_size", "bucket", "key", "id", "none", "print", "root", "part", "spans", "h", "item", "group", "bin",
           "offset", "length", "kept", "n_lines", "score", "quality", "held_out", "fingerprint", "half", "word")


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta", "ÉTÉ", "日本", "x", "😀", "é"]
    long = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(30_000))
    texts = [(1, ""), (2, None), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "one two\nthree four five six"), (6, "one two\nthree four five six"),
             (6, "another text of the same id"), (7, long), (8, long + " end"), (9, long), (None, "no id at all here"), (None, None), (10, "ONE\x00two\x1c three")]
    texts += [(20 + i, f"shared line\nown {i}\n Shared LINE \n\n") for i in range(12)]
    rows = [(i, t, "en", None if i is None else f"s{i % 3}", None, *["clash"] * len(CLASHES)) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(nasty):
    return nasty.filter("false")


@pytest.fixture(scope="session")
def nasty_texts(nasty):
    return [(r.doc_id, r.text or "") for r in nasty.select("doc_id", "text").collect()]
