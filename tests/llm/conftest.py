import pytest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{DIR}/{name}.parquet")


@pytest.fixture(scope="session")
def larger(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


@pytest.fixture(scope="session")
def large(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
