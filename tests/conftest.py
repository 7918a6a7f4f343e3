import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrane.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("terrane-tests", cpus=4, memory="3g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
