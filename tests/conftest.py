import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from faultatlas.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture
def corpus(spark):
    """Files table from {path: content}."""
    from faultatlas.sources.files import load_files

    def make(sources: dict[str, str], repo: str = "r"):
        rows = [(repo, path, content) for path, content in sources.items()]
        return load_files(spark.createDataFrame(rows, "repo_key string, path string, content string"))

    return make
