from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key long, band int, row string"


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """A folder for checkpoints, only where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def make_docs(spark, texts, langs=None):
    """Documents with the given texts, and extra columns whose names the operators use themselves."""
    rows = [(n, t, (langs or {}).get(n, "en"), "s", len(t or ""), n, 0, "x") for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def prose(seed: int, n: int, letters: str = "abcdefgh") -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice(letters) for _ in range(pick.randint(2, 7))) for _ in range(n))
