from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def hard(spark, tmp_path_factory):
    from tables import folder

    return folder(spark, tmp_path_factory.mktemp("hard"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    from tables import folder

    return folder(spark, tmp_path_factory.mktemp("empty"), empty=True)
