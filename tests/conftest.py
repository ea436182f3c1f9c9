import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from accordant.session import local_session

    shared = tmp_path_factory.mktemp("shared").as_uri()
    session = local_session("tests", cores="4", shuffle_partitions=4, memory="4g", **{"spark.checkpoint.dir": shared})
    yield session
    session.stop()
