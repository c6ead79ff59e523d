from __future__ import annotations

import pytest

from cladeloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s
