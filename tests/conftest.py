import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for Python workers

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lendlens.session import local_session

    s = local_session("*", shuffle_partitions=8, app="lendlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_pipeline(spark):
    from lendlens.plans import AuditPipeline

    return AuditPipeline(spark, SF_SMALL)
