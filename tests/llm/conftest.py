import random

import pytest
from llm_rows import CLASHING, ODD
from pyspark.sql import functions as F

@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """Documents as files, with columns whose names operators use themselves."""

    def build(rows, clashing=False):
        frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if clashing:
            frame = frame.withColumns({c: F.lit("clash") for c in CLASHING})
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        frame.repartition(2).write.parquet(path)
        return spark.read.parquet(path)

    return build


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD, clashing=True)


@pytest.fixture(scope="session")
def none(make):
    return make([])


@pytest.fixture()
def prose():
    rng = random.Random(5)
    syllables = "ta ko ri men sul va per ino el da".split()

    def text(words, seed=None):
        pick = random.Random(seed) if seed is not None else rng
        return " ".join("".join(pick.choice(syllables) for _ in range(pick.randint(1, 4))) for _ in range(words))

    return text
