import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gristmill.scratch import new_folder  # noqa: E402
from gristmill.session import local_session  # noqa: E402
from gristmill.sources.catalog import Catalog  # noqa: E402
from gristmill.sources.datasets import DatasetStore  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4)


@pytest.fixture
def store(spark):
    return DatasetStore(spark, new_folder(spark, "test"))


@pytest.fixture
def catalog(spark, store):
    return Catalog(spark, store)


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [("east", 10), ("west", 5), ("east", 30)], "region string, amount long"
    ).coalesce(1)


def rows(df, *order):
    found = df.orderBy(*order) if order else df
    return [tuple(row) for row in found.collect()]
