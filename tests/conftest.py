import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))  # for Spark's own Python processes
sys.path.insert(0, str(Path(__file__).resolve().parent / "llm"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewire.runtime import session

    s = session("tests", cpus="8", shuffle=4)
    s.sparkContext.setLogLevel("OFF")
    s._tidewire_dir = str(tmp_path_factory.mktemp("shared"))
    yield s
    s.stop()
