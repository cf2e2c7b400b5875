import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import session

    spark = session("local[4]", 4, spark_ui_showConsoleProgress="false", spark_driver_memory="4g")
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()
