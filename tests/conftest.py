import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from helixframe.session import local_session

    return local_session("4", 4)


@pytest.fixture(scope="session")
def sf():
    return SF


def rounded(rows):
    """Rows in an order of their own, floats to six places."""
    out = [tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))
