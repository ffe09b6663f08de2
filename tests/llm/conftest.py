import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "er", "th", "on", "re", "st", "il", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    long_text = prose(99, 30_000) + " " + "x" * 9000 + " " * 6000
    rows = [(i, prose(i, 60 + 7 * i), "en", f"src{i % 3}", 1) for i in range(30)]
    rows += [(40, None, None, None, None), (41, "", "de", "src0", 0), (None, prose(3, 81), "en", "src1", 1), (None, None, "en", None, None), (42, long_text, "fr", "src2", 5), (5, prose(5, 95), "en", "src2", 1), (5, prose(5, 95), "en", "src2", 1)]
    rows += [(50 + i, prose(7, 400), "en", "src0", 1) for i in range(6)] + [(60, "\n \n\t", "en", "src0", 1), (61, "one", "en", "src0", 1), (62, "é" * 70 + " ñandú\nñandú\u0085x", "es", "src1", 1)]
    clashing = "fp long, piece int, shard int, path string, start int, _row int, _spans string, _entities int, _th int, _size int, _Shard int, _slot int, _fp int, _id int, _own int, th int, size int, row int, root int, least int, kind string, item_id int"
    return spark.createDataFrame([(*r, 7, 8, 9, "a", 1, 1, "s", 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, "k", 6) for r in rows], f"{DOC}, {clashing}")


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, 0) for i in range(20)] + [(i, 0, 1) for i in range(20, 28)] + [(None, 1, 0), (3, None, 0), (29, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
