import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from nearfield.runtime import session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="nearfield-tests-")
    spark = session(
        "nearfield-tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": folder,
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    ship_package(spark)
    yield spark
    spark.stop()


@pytest.fixture
def small_blocks(spark):
    """Force the shuffled paths: nothing is broadcast, blocks and slices are tiny."""
    names = {
        "spark.nearfield.broadcastBytes": "0",
        "spark.nearfield.blockRows": "16",
        "spark.nearfield.sliceRows": "8",
    }
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.fixture(params=["broadcast", "shuffled"])
def paths(request):
    if request.param == "shuffled":
        request.getfixturevalue("small_blocks")
    return request.param
