import pytest

from chainloom import session
from tests.check import spark_session


@pytest.fixture(scope="session")
def spark():
    spark = session.prepare(spark_session())
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
