import datetime as dt
import os

from quakes.__main__ import main

from test_sources import feature, write_page


def test_cli_list(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "q29" in out and "7.1." in out and len(out.strip().splitlines()) == 31


def test_cli_build_and_query(spark, tmp_dir, capsys):
    land = tmp_dir + "/landing"
    os.makedirs(land)
    write_page(f"{land}/2024-01.json", [
        feature("1", dt.datetime(2024, 1, 5), [140.0, 35.0, 10.0], place="5 km N of Town, Japan", mag=6.1),
        feature("2", dt.datetime(2024, 1, 5, 0, 20), [140.1, 35.1, 400.0], place="Banda Sea", mag=4.2),
        feature("3", dt.datetime(2024, 1, 9), [], place=None, mag=None),
    ])
    table = tmp_dir + "/eq"
    assert main(["build", land, table]) == 0
    assert "loaded 3 rows" in capsys.readouterr().out
    assert main(["query", table, "q12"]) == 0
    out = capsys.readouterr().out
    assert "S_No" in out and "Asia" in out and "Ocean/Other" in out and "unknown" in out
    assert main(["query", table, "12. Total estimated economic loss per continent", "--sql"]) == 0
    assert main(["query", table, "q29"]) == 0
    out = capsys.readouterr().out
    assert "us1" in out and "us2" in out
    assert main(["query", table, "nope"]) == 2
