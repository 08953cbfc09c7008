import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from treecorpus.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session()


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
