import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewater.session import create_session

    shared = tmp_path_factory.mktemp("shared")
    session = create_session(
        "tests", "local[4]", spark_ui_enabled="false", spark_sql_shuffle_partitions="4", spark_driver_memory="4g",
        spark_ui_showConsoleProgress="false", spark_checkpoint_dir=f"file://{shared}", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def engine(spark, tmp_path):
    from tidewater.engine import Engine

    return Engine(spark, root=str(tmp_path))
