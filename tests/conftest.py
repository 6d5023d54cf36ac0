from __future__ import annotations

import gzip
import json

import pytest

from tests.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session()


@pytest.fixture
def event_files(tmp_path):
    """Write {path below tmp: [records or raw lines]} as gzipped event files."""

    def write(files):
        for name, lines in files.items():
            path = tmp_path / "events" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            with gzip.open(path, "wt", encoding="utf-8") as out:
                for line in lines:
                    out.write((line if isinstance(line, str) else json.dumps(line)) + "\n")
        return str(tmp_path / "events" / "*" / "*.ndjson.gz")

    return write
