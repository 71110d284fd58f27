import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tokenloom.session import get_spark
    s = get_spark("local[4]", 8)
    yield s


@pytest.fixture(scope="session")
def letters_vocab(spark):
    """Vocabulary: <unk>=0 <s>=1 </s>=2, then a..z = 3..28."""
    from tokenloom.operators.vocab import SPECIAL_TOKENS, Vocabulary
    rows = [(i, t, 0.0) for i, t in enumerate(SPECIAL_TOKENS)]
    rows += [(3 + i, chr(ord("a") + i), float(-(3 + i))) for i in range(26)]
    table = spark.createDataFrame(rows, "id int, token string, score float")
    return Vocabulary(table, len(rows), 0, 1, 2)


def lid(ch: str) -> int:
    return 3 + ord(ch) - ord("a")
