import pytest

from ruletrace.llm.common import importable


@pytest.fixture(autouse=True)
def package_for_workers(spark):
    importable(spark)
