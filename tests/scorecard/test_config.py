import json
import subprocess
import sys
import warnings

import pytest

from tallymark.__main__ import main
from tallymark.plans.config import Config, template
from tallymark.plans.loans import loans
from tallymark.plans.report import table, to_html


@pytest.fixture(scope="module")
def raw(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    loans(spark, sf).drop("yr").coalesce(1).write.option("header", True).csv(f"{folder}/loans")
    return {
        "data": {"data_file": f"{folder}/loans", "target": "bad", "time_col": "apply_date", "dev_end": "1999-12-31", "oot_start": "2000-01-01"},
        "steps": {"mine_rules": "on"}, "rules": {"min_lift": 1.5}, "screening": {"iv_low": 0}, "modeling": {"n_min": 2, "n_max": 4},
        "variables": [{"variable": "qty", "special_values": "-999", "monotonic": "increasing", "dimension": "size"}],
    }


def test_all_errors_at_once():
    with pytest.raises(ValueError) as e:
        Config.parse({"data": {"target": "y", "dev_start": "2020"}, "binning": {"n_bins": 99, "bins": 3}, "modeling": {"coef_sign": "up"}, "odd": {}, "variables": [{"variable": "a"}, {"variable": "a", "monotonic": "zigzag"}, {}]})
    for part in ("data_file", "time_col", "n_bins", "binning.bins", "coef_sign", "odd", "twice", "zigzag", "no name"):
        assert part in str(e.value)


def test_run_writes_report_and_rules(spark, raw, tmp_path):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        chain = Config.parse(raw).execute(spark, str(tmp_path))
    assert chain.halted or {"trn_ks", "test_ks", "oot_ks"} <= set(chain.evaluation_)
    text = (tmp_path / "report.md").read_text()
    assert "## Overview" in text and "<table>" in (tmp_path / "report.html").read_text()
    compile(Config.parse(raw).script(), "script", "exec")


def test_command_line(tmp_path, capsys):
    assert main(["template", str(tmp_path)]) == 0
    assert json.loads((tmp_path / "scorecard.json").read_text()) == json.loads(json.dumps(template()))
    assert main(["run", str(tmp_path / "scorecard.json")]) == 1 and "needed" in capsys.readouterr().err
    assert main(["run", str(tmp_path / "none.json")]) == 1


def test_tables_and_html():
    text = "# T\n\n- a <b>\n\n" + table(["x|y", "z"], [("p|q", 1.0), (None, 2)], 1)
    assert "1 more rows" in text and "<th>x|y</th>" in to_html(text) and "<td>p|q</td>" in to_html(text) and "a &lt;b&gt;" in to_html(text)


def test_works_without_the_corpus_subpackage(tmp_path):
    """The entry point and the catalog import where tallymark.llm and corpus_pipeline are gone."""
    code = "import sys; sys.modules['tallymark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 70 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)
