import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import session

    s = session("local[4]", 4, spark_driver_memory="4g", spark_sql_warehouse_dir="/tmp/sparkloom-warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
