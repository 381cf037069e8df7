import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from trafficlens.session import build_session
    from trafficlens.streaming.detect import STATE_STORE

    session = build_session("tests", "local[4]", 4, {
        "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        "spark.sql.shuffle.partitions": "4", **STATE_STORE})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
