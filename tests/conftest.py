import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from biblioflow.session import get_spark

    s = get_spark("tests", cpus=4, shuffle_partitions=2)
    s.conf.set("spark.sql.codegen.wholeStage", "false")  # tiny tables: compiling takes longer than running
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
