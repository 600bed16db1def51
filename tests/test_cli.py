from biblioflow import cli
from tests.test_passes import LIBRARY, books


def test_run_and_undo(spark, tmp_path, capsys):
    call = lambda *a: cli.main(["--library", str(tmp_path), *a], spark)
    assert call("check") == cli.REFUSED and call("nonsense") == cli.REFUSED and call("runs") == cli.OK
    books(spark, LIBRARY).write.parquet(str(tmp_path / "books.parquet"))
    assert call("init") == cli.OK and call("init") == cli.REFUSED and call("check") == cli.OK
    assert call("run", "no-such-pass") == cli.REFUSED and call("undo", "none") == cli.NOTHING
    before = sorted(map(str, cli.current(spark, tmp_path).collect()))
    assert call("run", "tags", "publishers", "series", "--dry-run") == cli.OK and sorted(map(str, cli.current(spark, tmp_path).collect())) == before
    assert call("run", "tags", "publishers", "series") == cli.OK
    after = cli.current(spark, tmp_path)
    got = {r["id"]: r for r in after.collect()}
    assert got[2]["publisher"] == "Moor House" and got[2]["series"] == "Sea Song" and got[1]["tags"] == ["Fiction", "Sea"]
    run_id = sorted(d.name for d in (tmp_path / "runs").iterdir())[-1]
    assert call("undo", run_id) == cli.OK
    assert sorted(map(str, cli.current(spark, tmp_path).collect())) == before
    capsys.readouterr()
    assert call("runs") == cli.OK and len(capsys.readouterr().out.strip().split("\n")) == 3
