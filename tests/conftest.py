import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from trackloom.session import local_session

    return local_session(4, **{"spark.sql.shuffle.partitions": "4"})
