import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vellum.session import build_session, clear_scratch
    s = build_session("local[*]", shuffle_partitions=8)
    yield s
    clear_scratch(s)
    s.stop()


def chapters_df(spark, rows, book="b1"):
    """rows: list of (id, content) in submission order."""
    data = [(book, int(i), int(pos), c) for pos, (i, c) in enumerate(rows)]
    return spark.createDataFrame(data, "book_id string, id bigint, ordinal bigint, content string")
