import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weft.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sources(spark):
    """File rows out of a dict of name to bytes."""

    def make(files: dict[str, bytes], repo: str = "example"):
        rows = [(repo, name, bytearray(content)) for name, content in files.items()]
        return spark.createDataFrame(rows, "repo_name string, file_path string, content binary")

    return make
