import csv
import datetime as dt
import re

import pytest

from callsheet import __main__ as cli
from callsheet.__main__ import arguments, main
from callsheet.params import REPEATED_DIGIT_LITERAL
from callsheet.plans import catalogue as cat
from callsheet.plans.campaigns import LIST_COLUMNS
from callsheet.schemas import SCHEMAS
from callsheet.sources import tables
from callsheet.sources.tables import save
from testbed.domain import DomainTables
from tests.conftest import SMALL

DATES = ["--as-of", "2024-02-15", "--agreements-since", "1999-01-01"]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "tables")
    derived = DomainTables(spark, SMALL)
    save({name: derived[name] for name in SCHEMAS}, path)
    return path


def lists(out):
    """Rows per list, read back from the files."""
    found = {}
    for file in out.glob("*.csv"):
        name = re.fullmatch(r"(.*)_\d{8}_\d{6}\.csv", file.name)[1]
        with open(file, encoding="utf-8-sig", newline="") as f:
            header, *rows = csv.reader(f, delimiter=";")
        found[name] = (header, found.get(name, (header, 0))[1] + len(rows))
    return found


def test_one_list(spark, source, tmp_path):
    out = tmp_path / "one"
    main(["list", "geral", "--source", source, "--portfolio", "518", "--phones", "3", "--min-sum", "500.000,00",
          "--label", "BUILDING 0", "--label", "D'AVILA (IV)", "--out", str(out), *DATES], spark)
    assert lists(out) == {"DivZeroPF_Geral_BUILDING0_DAVILAIV": (LIST_COLUMNS, 10)}


def test_todays_list_for_all_portfolios(spark, source, tmp_path):
    out = tmp_path / "today"
    main(["list", "today", "--source", source, "--out", str(out), "--last-contact", *DATES], spark)
    header = [*LIST_COLUMNS, "dt_ultimo_cpc", "DtUltimoCPC_fmt"]
    # 2024-02-15 is a Thursday.
    assert lists(out) == {
        "AutosPF_Geral": (header, 10), "DivZeroPF_Geral": (header, 57), "CedidasPF_Geral": (header, 29)}


def test_the_week(spark, source, tmp_path):
    out = tmp_path / "week"
    main(["list", "week", "--source", source, "--out", str(out), *DATES], spark)
    assert sum(rows for _, rows in lists(out).values()) == 390
    assert len(lists(out)) == 15


def test_nothing_is_due_on_sundays(spark, source, tmp_path):
    with pytest.raises(SystemExit, match="no list is due"):
        main(["list", "today", "--source", source, "--out", str(tmp_path / "x"), "--as-of", "2024-02-18"], spark)


def test_summary(spark, source, tmp_path):
    out = tmp_path / "counts"
    main(["summary", "--source", source, "--portfolio", "519", "--out", str(out)], spark)
    read = lambda name: b"".join(p.read_bytes() for p in (out / name).glob("part-*")).decode("utf-8-sig")
    assert re.fullmatch(r"cod_cli;total_contratos\r\n519;\d+\r\n", read("totals"))
    assert "D'AVILA (IV)" in read("labels") and "518" not in read("labels")


def test_options_reach_the_run(monkeypatch, spark, source, tmp_path):
    seen = []
    monkeypatch.setattr(cli, "campaign_list", lambda tables, campaign, params, *a, **k: seen.append(params))
    monkeypatch.setattr(cli, "export_lists", lambda *a: None)
    main(["list", "geral", "--source", source, "--out", str(tmp_path / "x"), "--contact-days", "20",
          "--recent-months", "3", "--exclude-system-events", "--dedupe-sum", "--literal-digit-run"], spark)
    (params,) = seen
    assert (params.contact_days, params.recent_months, params.repeated_digits) == (20, 3, REPEATED_DIGIT_LITERAL)
    assert params.exclude_system_events and params.dedupe_sum


def test_a_jdbc_source_takes_its_options_from_a_file(monkeypatch, spark, tmp_path):
    seen = []
    monkeypatch.setattr(tables, "load_jdbc", lambda spark, url, options: seen.append((url, options)))
    monkeypatch.setattr(cli, "run_summary", lambda *a: None)
    (tmp_path / "jdbc.json").write_text('{"user": "u"}')
    main(["summary", "--source", "jdbc:mysql://h/db", "--out", "x", "--jdbc-options", str(tmp_path / "jdbc.json")], spark)
    assert seen == [("jdbc:mysql://h/db", {"user": "u"})]


def test_arguments():
    args = arguments(["list", "week", "--source", "s", "--out", "o"])
    assert args.portfolio == (517, 518, 519)
    assert args.as_of == dt.date.today()
    with pytest.raises(SystemExit):
        arguments(["list", "other", "--source", "s", "--out", "o"])
    assert {c.id for c in cat.WEEK} <= {"seg_quebras_rcs", "ter_cpc", "qua_nunca_contatados", "geral", "base_recente"}
