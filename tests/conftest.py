import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vulnscan.session import get_spark, local_settings

    s = get_spark("vulnscan-tests", **local_settings("*"))
    s.sparkContext.setLogLevel("ERROR")
    # Tests only: no cluster-provided checkpoint folder, so set one here.
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


def rows(df, cols=None):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
