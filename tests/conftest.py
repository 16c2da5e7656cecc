import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

import harness  # noqa: E402


@pytest.fixture(scope="session")
def shared_folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session")
def spark(shared_folder):
    session = harness.session(**{"spark.checkpoint.dir": shared_folder, "spark.sql.warehouse.dir": f"{shared_folder}/tables"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
