import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gitquarry.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, driver_memory="4g")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield s
