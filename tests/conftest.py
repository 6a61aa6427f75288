import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4", spark__sql__adaptive__coalescePartitions__initialPartitionNum="4",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def dump(tmp_path):
    """Write lines (text, or objects to encode) to an extensionless file and return its path."""

    def write(name, lines, folder="dumps"):
        path = tmp_path / folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        texts = [line if isinstance(line, str) else json.dumps(line) for line in lines]
        path.write_text("".join(t + "\n" for t in texts), encoding="utf-8")
        return str(path)

    return write
