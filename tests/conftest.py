import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factwright import session


@pytest.fixture(scope="session")
def spark():
    s = session.build(
        "local[4]", shuffle_partitions=4,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/w/warehouse"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
