import pytest

from strandweave.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, **{"spark.sql.shuffle.partitions": "3", "spark.default.parallelism": "3", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()
