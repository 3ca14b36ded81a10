import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from parley.session import get_spark

    s = get_spark(master="local[*]", shuffle_partitions=8,
                  conf={"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    from parley.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="parley-test-ckpt-"))
    yield s
    s.stop()


def utt(spark, rows):
    """rows: (session_id, turn, speaker, utterance)."""
    return spark.createDataFrame(rows, "session_id string, turn long, speaker string, utterance string")
