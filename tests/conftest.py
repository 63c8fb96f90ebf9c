import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from wavemark.session import session

    local = tmp_path_factory.mktemp("spark")
    made = session("local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g", spark_local_dir=str(local), spark_sql_warehouse_dir=str(local / "warehouse"))
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
