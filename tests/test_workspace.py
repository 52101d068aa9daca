import pytest

from golden import BASELINE, MODIFIED
from weft.__main__ import main
from weft.sources.files import scan_files
from weft.workspace import ReplayError, Workspace


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src" / "probe.py").write_bytes(BASELINE)
    (root / "src" / "__init__.py").write_bytes(b"")
    (root / "broken.py").write_bytes(b"def (")
    return root, str(tmp_path / "ws")


def test_life_of_a_repository(spark, place, tmp_path, capsys):
    """Parse, ingest, verify, change a file, replay it, resume, clean up and reset."""
    root, ws = place
    repo = ["--root", str(root), "--repo", "r"]
    probe = ["--file", "src/probe.py"]

    assert main(["discover", *repo, "--output", str(tmp_path / "manifest")]) == 0
    assert "Discovered 3 Python files" in capsys.readouterr().out
    assert main(["parse", *repo, "--workspace", ws, "--dry-run"]) == 0
    assert "successful=2 failed=1" in capsys.readouterr().out
    assert main(["parse", *repo, "--workspace", ws]) == 0
    assert main(["ingest", "--workspace", ws]) == 0
    assert main(["verify-graph", "--workspace", ws, "--repo", "r", *probe]) == 0
    assert "|10        |18        |" in capsys.readouterr().out
    assert main(["verify-metadata", "--workspace", ws, "--repo", "r", *probe]) == 0

    (root / "src" / "probe.py").write_bytes(MODIFIED)
    assert main(["replay", *repo, *probe, "--workspace", ws, "--output", str(tmp_path / "evidence")]) == 0
    shown = capsys.readouterr().out
    for line in ("node_count_after=14", "edge_count_after=26", "documents_delta=+0", "passed=true"):
        assert line in shown
    assert main(["resume-check", "--workspace", ws, "--seconds", "0"]) == 0
    assert main(["stats", "--workspace", ws]) == 0
    assert "file r:src/probe.py" in capsys.readouterr().out

    # A file the store has never seen changes the number of documents.
    (root / "src" / "late.py").write_bytes(b"x = 1\n")
    assert main(["replay", *repo, "--file", "src/late.py", "--workspace", ws]) == 3
    assert main(["cleanup", "--workspace", ws, "--repo", "r", "--file", "src/late.py"]) == 0
    assert "nodes_deleted=5" in capsys.readouterr().out
    assert main(["verify-graph", "--workspace", ws]) == 0
    assert main(["reset", "--workspace", ws]) == 0
    assert main(["ingest", "--workspace", ws]) == 0
    assert main(["verify-metadata", "--workspace", ws]) == 0
    assert "|3        |" in capsys.readouterr().out


def test_failed_replay_changes_nothing(spark, place):
    """A broken or absent file is an error, and the stored graph stays."""
    root, path = place
    stores = Workspace(spark, path)
    stores.publish(scan_files(spark, str(root), "r"))
    stores.ingest()
    before = sorted(r.id for r in stores.graph.nodes.read().collect())
    for name, content in (("src/probe.py", b"def ("), ("gone.py", None)):
        if content is not None:
            (root / name).write_bytes(content)
        with pytest.raises(ReplayError):
            stores.replay(scan_files(spark, str(root), "r", only=name), "r", name)
        stores.ingest()
        assert sorted(r.id for r in stores.graph.nodes.read().collect()) == before
    assert main(["replay", "--root", str(root), "--repo", "r", "--file", "gone.py", "--workspace", path]) == 3
