import json
import subprocess
import sys
from pathlib import Path


def test_exports_survive_task_failures():
    script = Path(__file__).parent / "scripts" / "retry_check.py"
    run = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=600)
    line = [l for l in run.stdout.splitlines() if l.startswith("{")]
    assert line, run.stderr[-2000:]
    result = json.loads(line[-1])
    assert result["equal"] and all(size > 0 for size in result["sizes"])
