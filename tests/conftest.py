import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulseweave.lineage import drop_scratch  # noqa: E402
from pulseweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[*]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def shared_views():
    """Views that many queries build on, made once for the whole test run."""
    from functools import lru_cache

    from workload import views

    patch = pytest.MonkeyPatch()
    for name in ("doc_graph", "members", "links"):
        patch.setattr(views, name, lru_cache(maxsize=None)(getattr(views, name)))
    yield
    patch.undo()
