import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casebook.llm.tables import ship

SYLLABLES = "an the er in on re is to of ba lo mi ka tu vé ßa ño".split()


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark.sparkContext)
    return spark


class Texts:
    """Invented prose."""

    def __init__(self, seed=5):
        self.r = random.Random(seed)

    def word(self):
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def prose(self, n):
        return " ".join(self.word() + ("." if self.r.random() < 0.08 else "") for _ in range(n))

    def edited(self, text, share):
        return " ".join(self.word() if self.r.random() < share else w for w in text.split(" "))


@pytest.fixture
def texts():
    return Texts()


@pytest.fixture(scope="session")
def odd(llm):
    """Documents that are null, empty, blank, repeated, very long, in other scripts; with clashing extra columns."""
    t = Texts(9)
    long = "\n".join(t.prose(12) for _ in range(1500))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, t.prose(80)), (5, "word"), (5, "word"), (None, t.prose(60)), (6, long), (7, "а" * 5000), (8, "é ñ | # <b> \\ </s>"),
        (9, long[:3000]), (-3, "x\x00y " * 60),
    ]
    schema = "doc_id bigint, text string, score string, kept string, n_words string, hash string, mark string, label int"
    return llm.createDataFrame([(i, x, "s", "k", "n", "h", "m", 1) for i, x in rows], schema)
