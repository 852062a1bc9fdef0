import os
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(HOME))
os.environ["PYTHONPATH"] = f"{HOME}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session, share_package

    s = local_session("4", 4, **{"spark.driver.memory": "3g", "spark.sql.session.timeZone": "UTC"})
    s.sparkContext.setLogLevel("ERROR")
    share_package(s)
    yield s
    s.stop()
