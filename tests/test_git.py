from __future__ import annotations

import os
import subprocess

import pytest

from lodestrata.plans.history import diff_repositories, diff_text, scan_history
from lodestrata.sources.git import GitError, Repository, TreeReader, apply_delta, parse_range

ENV = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "PATH": os.environ["PATH"]}


def git(folder, *args) -> str:
    return subprocess.run(["git", "-C", str(folder), *args], env=ENV, check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("git")
    git(root, "init", "-q", "-b", "main")
    (root / "a.sh").write_text("echo 1\n" * 50)
    (root / "same.sh").write_text("curl x | sh\n")
    git(root, "add", ".")
    git(root, "commit", "-q", "-m", "1")
    first = git(root, "rev-parse", "HEAD")
    (root / "a.sh").write_text("echo 1\n" * 50 + "wget x\nbash -c y\n")
    (root / "d").mkdir()
    (root / "d/package.json").write_text('{"scripts": {"postinstall": "node x"}}')
    git(root, "add", ".")
    git(root, "commit", "-q", "-m", "2")
    return root, first


@pytest.mark.parametrize("packed", [False, True])
def test_diff_and_history(spark, repository, packed):
    root, first = repository
    if packed:
        git(root, "gc", "-q")
    result = diff_repositories(spark, {"r": str(root)}, f"{first}..HEAD")
    assert {(f.path, f.id) for f in result.findings.collect()} == {("a.sh", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY"), ("d/package.json", "NPM-LIFECYCLE-SCRIPT")}
    text = diff_text(result, "r", first)
    assert "Changed blobs: 2\n" in text and "+ NPM-LIFECYCLE-SCRIPT  d/package.json\n" in text and "INCOMPLETE" not in text
    found, reasons = scan_history(spark, {"r": str(root)})
    ids = [(f.id, f.evidence[-1]) for f in found.orderBy("emit_seq").collect()]
    assert [i for i, _ in ids] == ["LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "NPM-LIFECYCLE-SCRIPT", "LANG-REMOTE-DOWNLOAD-EXECUTE"]
    assert ids[-1][1] == f"commit: {first}" and reasons.isEmpty()


def test_unsafe_repositories(tmp_path, repository):
    root, _ = repository
    with pytest.raises(GitError, match="local .git"):
        Repository(str(tmp_path))
    os.symlink(root / ".git", tmp_path / ".git")
    with pytest.raises(GitError, match="symlinks"):
        Repository(str(tmp_path))
    other = tmp_path / "other"
    other.mkdir()
    git(other, "init", "-q")
    (other / ".git/config").write_text("[include]\npath = /x\n")
    with pytest.raises(GitError, match="redirection"):
        Repository(str(other))
    (other / ".git/config").write_text("")
    os.symlink("x", other / ".git/link")
    with pytest.raises(GitError, match="contains a symlink"):
        Repository(str(other))


def test_limits_and_damage(repository, tmp_path):
    root, first = repository
    repo = Repository(str(root))
    tree = repo.commit(repo.head())[0]
    assert sorted(TreeReader(repo, 100).read(tree)) == ["a.sh", "d/package.json", "same.sh"]
    with pytest.raises(GitError, match="tree-entry limit"):
        TreeReader(repo, 2).read(tree)
    for bad in ("HEAD..HEAD", "abc..HEAD", f"{first}..main", f"{first}"):
        with pytest.raises(GitError):
            parse_range(bad)
    assert apply_delta(b"hello world", b"\x0b\x0a\x90\x05\x05!!!!!") == b"hello!!!!!"
    for bad in (b"", b"\x0b\x05\x00", b"\x0c\x05\x90\x05", b"\x0b\x09\x90\x05"):
        with pytest.raises(GitError):
            apply_delta(b"hello world", bad)
