"""A third of all rows have one key; still no task reads much more than its share."""

import json
import os
import subprocess
import sys

ROWS = 300_000


def test_no_task_gets_the_hot_key(tmp_path):
    script = os.path.join(os.path.dirname(__file__), "skew_run.py")
    run = subprocess.run([sys.executable, script, str(tmp_path)], capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    sizes = json.loads(run.stdout.strip().splitlines()[-1])
    assert {"flow", "flow at one time", "stays", "commits by role", "ranks", "merge requests"} <= sizes.keys()
    for job, stages in sizes.items():
        for records in stages:
            # An even share is a sixteenth; the hot key would be a third of all rows.
            assert max(records) < max(sum(records), ROWS) / 6, (job, records)
