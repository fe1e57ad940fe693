import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weftline.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return DATA


RAW = "raw_id BIGINT, source_file STRING, source_row BIGINT, prompt STRING, citation_category STRING, href STRING, hostname STRING, html_content STRING"


@pytest.fixture(scope="session")
def make_raw(spark):
    """Raw rows of (id, host, payload); columns of odd names come with them."""

    def make(rows):
        table = [(i, "f", i, None, "top", None if h else "https://b.test/x", h, p, "x", "y", 1) for i, h, p in rows]
        return spark.createDataFrame(table, RAW + ", site STRING, key STRING, pages INT")

    return make
