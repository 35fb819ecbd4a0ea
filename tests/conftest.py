import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="tallyspark-tests")
    yield s


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="tallyspark-test-")


def read_parts(path: str) -> bytes:
    """Concatenate part files in name order (the report's bytes)."""
    import gzip

    out = b""
    for p in sorted(Path(path).glob("part-*")):
        data = p.read_bytes()
        out += gzip.decompress(data) if p.suffix == ".gz" else data
    return out


def plan_text(df, mode: str = "formatted") -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()
