import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tally.session import build_session
    s = build_session("local[4]", app="tally-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture()
def write_csv(tmp_path):
    """Write ledger files under <tmp>/ledgers/account_id=<acc>/<name> and
    return their paths."""
    base = tmp_path / "ledgers"

    def _write(files: dict[tuple[str, str], str]):
        paths = []
        for (acc, name), body in files.items():
            d = base / f"account_id={acc}"
            d.mkdir(parents=True, exist_ok=True)
            p = d / name
            p.write_text(body, encoding="utf-8")
            paths.append(str(p))
        return str(base), paths

    return _write
