"""The command line drives the same operators (one session per test run)."""

import os
import re

from tidepool import cli
from tidepool.session import work_path

from conftest import SF_SMALL


def test_cli_commands(spark, capsys, tmp_path):
    root = work_path(spark, "t_cli")
    base = ["--root", root, "--tables", SF_SMALL, "--rows", "5"]
    assert cli.main(base + ["sql", "SELECT count(*) AS n FROM nation"]) == 0
    assert "25" in capsys.readouterr().out
    lines = tmp_path / "lines.txt"
    lines.write_text("first\nsecond\nthird\n")
    cli.main(base + ["tail", str(lines), "2"])
    out = capsys.readouterr().out
    assert "second" in out and "third" in out and "first" not in out
    cli.main(base + ["search", "documents", "the", "--size", "3"])
    assert "doc_id" in capsys.readouterr().out
    cli.main(base + ["index", "add", "idx1"])
    cli.main(base + ["index", "add", "idx1", '{"message": "hello", "n": 1}'])
    cli.main(base + ["index", "count", "idx1"])
    assert re.search(r"\|\s*2\s*\|", capsys.readouterr().out)
    cli.main(base + ["index", "search", "idx1", "hello"])
    out = capsys.readouterr().out
    assert "hello" in out and "test document" not in out
    cli.main(base + ["index", "list"])
    assert re.search(r"idx1\s*\|\s*2\s*\|\s*2\s*\|", capsys.readouterr().out)
    cli.main(base + ["index", "compact", "idx1"])
    cli.main(base + ["index", "drop", "idx1"])
    cli.main(base + ["index", "list"])
    assert "idx1" not in capsys.readouterr().out
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\nhal")
    cli.main(base + ["follow", str(folder), "--seconds", "6"])
    out = capsys.readouterr().out.split()
    assert "one" in out and "two" in out and "hal" not in out
    cli.main(base + ["pi", "4"])
    assert "pi" in capsys.readouterr().out
    assert os.path.isabs(root.replace("file:", "")) or "://" in root


def test_cli_collections_and_snapshots(spark, capsys, tmp_path):
    root = work_path(spark, "t_cli2")
    base = ["--root", root, "--rows", "50"]
    src = tmp_path / "users.json"
    src.write_text('[{"name": "Customer#1", "segment": "BUILDING", "size": 7}, {"name": "Customer#2", "segment": "AUTO", "size": 5}]')
    cli.main(base + ["create-db", "cli_app", "analyst"])
    cli.main(base + ["import", "--array", str(src), "cli_app", "users"])
    assert re.search(r"\|\s*2\s*\|", capsys.readouterr().out)
    cli.main(base + ["list-tables", "cli_app"])
    assert "users" in capsys.readouterr().out
    cli.main(base + ["export", "cli_app", "users", "--array"])
    exported = capsys.readouterr().out.strip().splitlines()[-1]
    assert "users-" in exported and exported.endswith(".json")
    cli.main(base + ["backup", "cli_app"])
    sid = capsys.readouterr().out.strip().splitlines()[-1]
    cli.main(base + ["create-db", "cli_copy"])
    cli.main(base + ["restore", sid, "cli_copy"])
    assert "users" in capsys.readouterr().out
    assert spark.table("cli_copy.users").count() == 2
    cli.main(base + ["expired", "--days", "7"])
    assert sid not in capsys.readouterr().out  # a fresh snapshot is kept
    cli.main(base + ["stats", "cli_copy.users"])
    assert "rows" in capsys.readouterr().out
    cli.main(base + ["list-db"])
    assert "cli_copy" in capsys.readouterr().out
