import sys

import pytest
from paths import ROOT, SF_SMALL

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pricelab.session import local_session
    s = local_session(cpus=8, shuffle_partitions=8, app="pricelab-tests")
    yield s


@pytest.fixture(scope="session")
def raw_small(spark):
    from pricelab.plans.catalog import raw_catalog
    return raw_catalog(spark, SF_SMALL)


@pytest.fixture(scope="session")
def clean_small(spark):
    from pricelab.plans.catalog import cleaned_catalog
    return cleaned_catalog(spark, SF_SMALL)
