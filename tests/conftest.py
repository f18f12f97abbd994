from __future__ import annotations

import pytest

from alertloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")
