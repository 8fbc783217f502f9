import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from rankloom.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", shuffle_partitions=3)
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate one column expression on literal inputs."""

    def run(expression, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return row.select(expression.alias("out")).first()["out"]

    return run
