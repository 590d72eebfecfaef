import pytest

from reachmap.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = local_session("local[8]", **{"spark.driver.memory": "4g"}, **shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def value(spark):
    """Evaluate one expression over rows of one string column ``x``."""

    def run(expression, rows, schema="x string"):
        table = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        return [r.y for r in table.coalesce(1).select(expression.alias("y")).collect()]

    return run
