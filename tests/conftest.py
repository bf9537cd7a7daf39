import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lapse.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", 8, app_name="lapse-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="lapse-test-ckpt-")})
    yield s


def rows(df, order=None):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
