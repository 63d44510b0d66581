"""The command line lists, runs and prints the oracle of registered queries."""

from stewardlake.__main__ import main


def test_cli_list_sql_and_run(spark, tmp_path, capsys):
    assert main(["list"]) == 0
    listed = capsys.readouterr().out.split()
    assert "access_state" in listed and len(listed) >= 140
    assert main(["run", "top_domains", "--sql"]) == 0
    assert "n_products" in capsys.readouterr().out
    out = tmp_path / "top"
    assert main(["run", "top_domains", "--sf-dir", "/root/testdata/sf0.001", "--out", str(out)]) == 0
    assert spark.read.parquet(str(out)).count() == 5
    assert main(["run", "no_such_query"]) == 2
