import os

import pytest

from tidemark import __main__ as cli
from tidemark import report

DATA = "/root/testdata/sf0.01"


def test_page_escapes_and_ticks_cover():
    page = report.html({"symbol": "<b>", "daily": [{"close": 1.0}, {"close": 2.0}], "incidents": [{"x": "<script>"}], "headlines": [], "model": [], "diagnostics": []})
    assert "<script>" not in page and "&lt;script&gt;" in page and "&lt;b&gt;" in page and "<svg" in page
    assert report.ticks(0.0, 1.0) == [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0] and report.ticks(3.0, 3.0) == [3.0]
    assert report.line_chart([None, 1.0]) == "" and report.table_text([]) == "no rows"


@pytest.mark.skipif(not os.path.exists(DATA), reason="tables are not here")
def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["queries"]) == 0 and "e4_incidents" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "--data", DATA]) == 2
    assert cli.main(["analyze", "HAVR0007", "--data", DATA, "--json", str(tmp_path / "a.json"), "--html", str(tmp_path / "a.html")]) == 0
    out = capsys.readouterr().out
    assert ("rank" in out or "no rows" in out) and (tmp_path / "a.html").read_text().startswith("<!doctype")
