import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siltflow.session import local_session

    base = tmp_path_factory.mktemp("spark")
    s = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{base}/ckpt", "spark.sql.warehouse.dir": f"{base}/warehouse", "spark.driver.memory": "3g"})
    yield s
    s.stop()
