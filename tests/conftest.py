import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from seqcast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = Path(tempfile.mkdtemp(prefix="seqcast-tests-"))
    session = build_session(
        "seqcast-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__checkpoint__dir=(folder / "shared").as_uri(),
        spark__sql__warehouse__dir=(folder / "warehouse").as_uri(),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
