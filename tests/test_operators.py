import datetime as dt
from collections import Counter
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from callsheet.operators import agreements as agr
from callsheet.operators import contacts as con
from callsheet.operators import contracts as ctr
from callsheet.operators import phones as pho
from callsheet.operators import portfolios as por
from callsheet.params import CampaignParams
from callsheet.plans import catalogue as cat
from callsheet.plans.campaigns import LIST_COLUMNS, campaign_list, weekly_lists

DAY = dt.date(2024, 2, 15)
SINCE = dt.date(2024, 1, 1)


def at(days_ago, hour=12):
    return dt.datetime.combine(DAY - dt.timedelta(days=days_ago), dt.time(hour))


def agreement(cod_aco, nmcont, staco, cod_cli=517, **more):
    return {"cod_aco": cod_aco, "nmcont": nmcont, "cod_cli": cod_cli, "staco": staco, "data_cad": DAY, **more}


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_equal_statuses_rank_by_phone(make):
    rows = [{"cod_cad": 1, "dddfone": "11", "telefone": t, "status": 2} for t in ("93", "91", "92")]
    ranked = pho.rank_phones(pho.number_phones(make("fones_tb", *rows)))
    assert [r["telefone"] for r in ranked.orderBy("num").collect()] == ["91", "92", "93"]


def test_one_number_under_two_statuses_fills_two_slots(make):
    phone = {"cod_cad": 1, "dddfone": "11", "telefone": "91234567"}
    rows = [{**phone, "status": 2}, {**phone, "status": 4}, {**phone, "status": 2, "obs": "ok"}]
    wide = pho.widen_phones(pho.rank_phones(pho.clean_phones(make("fones_tb", *rows), "strict")))
    row = wide.first()
    assert (row["Telefone1"], row["Telefone2"], row["Telefone3"]) == ("1191234567", "1191234567", None)


def test_newest_agreement_is_per_portfolio_and_cutoff(make):
    table = make(
        "acordos_tb",
        agreement(1, "A", "P"),
        agreement(2, "A", "Q"),
        agreement(3, "A", "P", data_cad=SINCE - dt.timedelta(days=1)),
        agreement(4, "A", "G", cod_cli=518),
    )
    newest = agr.newest_agreement(table, SINCE)
    assert pairs(newest.select("cod_cli", "cod_aco")) == [(517, 2), (518, 4)]
    assert pairs(agr.contracts_in_status(newest, "PGA")) == [(518, "A")]


def test_latest_agreement_leaves_out_unknown_statuses(make):
    table = make("acordos_tb", agreement(1, "A", "C"), agreement(2, "B", "E", qtd_p_aco=1))
    assert pairs(agr.latest_agreement(table, SINCE)) == [
        (517, "B", None, "AVISTA", "15-02-2024", "Exceção Rejeitada")]


@pytest.mark.parametrize(
    "paid, left",
    [
        ([], [(517, "A"), (517, None), (518, "A")]),
        ([(517, "A")], [(518, "A")]),
        ([(517, "B")], [(517, "A"), (518, "A")]),
        # One unnamed paid contract empties its own portfolio only.
        ([(517, None)], [(518, "A")]),
    ],
)
def test_not_in_is_null_aware_per_portfolio(spark, paid, left):
    schema = "cod_cli int, nmcont string"
    contracts = spark.createDataFrame([(517, "A"), (517, None), (518, "A")], schema)
    got = agr.exclude_paid(contracts, spark.createDataFrame(paid, schema), [517, 518])
    assert {tuple(r) for r in got.select("cod_cli", "nmcont").collect()} == set(left)


def test_values_count_each_invoice_per_complement_row(make):
    complements = make(
        "rec_comp_tb",
        {"nmcont": "A", "cod_cli": 517, "int_2": 1, "char_5": "X"},
        {"nmcont": "A", "cod_cli": 517, "int_2": 9, "char_5": "X"},
        {"nmcont": "B", "cod_cli": 517, "int_2": 3},
        {"nmcont": "C", "cod_cli": 517, "int_2": 4},
        {"nmcont": None, "cod_cli": 517, "int_2": 5},
    )
    receivables = make(
        "receber_tb",
        {"nmcont": "A", "cod_cli": 517, "fat_parc": "F2", "vlrparc": Decimal("10.50")},
        {"nmcont": "A", "cod_cli": 517, "fat_parc": "F1", "vlrparc": Decimal("1.00")},
        {"nmcont": "A", "cod_cli": 517, "fat_parc": "F1", "vlrparc": Decimal("1.00")},
        {"nmcont": "A", "cod_cli": 517, "fat_parc": "x Entrada", "vlrparc": Decimal("99.00")},
        {"nmcont": "B", "cod_cli": 517, "fat_parc": "F1"},
        {"nmcont": "C", "cod_cli": 517, "fat_parc": None, "vlrparc": Decimal("5.00")},
        {"nmcont": "C", "cod_cli": 518, "fat_parc": "F1", "vlrparc": Decimal("5.00")},
        {"nmcont": None, "cod_cli": 517, "fat_parc": "F1", "vlrparc": Decimal("5.00")},
    )
    values = ctr.contract_values(complements, receivables)
    columns = ["nmcont", "Contratos", "TipoProduto", "BindingID", "soma"]
    assert pairs(values.select(columns)) == [
        ("A", "F1 || F2", "X", 9, Decimal("25.00")), ("B", "F1", None, 3, None)]
    at_least = ctr.contract_values(complements, receivables, min_sum=Decimal("25.00"))
    assert pairs(at_least.select("nmcont")) == [("A",)]
    single = ctr.contract_values(complements, receivables, Decimal("12.50"), dedupe_sum=True)
    assert pairs(single.select("nmcont", "soma")) == [("A", Decimal("12.50"))]


def test_collateral_shows_the_lowest_plate(make):
    good = {"nmcont": "A", "cod_cli": 517}
    table = make(
        "bens_tb",
        {**good, "chassi": "1", "placa": None, "marca": "no", "modelo": "plate"},
        {**good, "chassi": "2", "placa": "B", "marca": "x", "modelo": "y"},
        {**good, "chassi": "2", "placa": "A", "marca": "x", "modelo": None, "anofab": 1999, "anomodelo": 2000},
        {"nmcont": "B", "cod_cli": 517, "placa": None, "marca": "only", "modelo": "one"},
    )
    assert pairs(ctr.collateral(table).select("nmcont", "placa", "MarcaModelo", "AnoFabModelo", "QtdGarantiasUnicas")) == [
        ("A", "A", None, "1999/2000", 2), ("B", None, "only - one", None, 0)]


def test_collateral_of_copies_null_keys_and_hot_contracts(make):
    rows = [
        {"nmcont": [None, "A", "B"][n % 3], "cod_cli": [517, 518, None][n % 7 % 3], "chassi": [None, "1", "2", "3"][n % 4],
         "placa": [None, "P2", "P1"][n % 5 % 3], "marca": "m", "modelo": [None, "x", "y"][n % 11 % 3], "cor": str(n % 13),
         "anofab": 1990 + n % 3, "anomodelo": 2000}
        for n in range(600)
    ]
    rows += rows[:50]

    def shown(r):
        model = r["modelo"] and f"{r['marca']} - {r['modelo']}"
        return r["placa"], model, r["cor"], f"{r['anofab']}/{r['anomodelo']}"

    contracts, order = {}, lambda g: [(x is not None, x or "") for x in g]
    for r in rows:
        contracts.setdefault((r["nmcont"], r["cod_cli"]), []).append(r)
    want = Counter()
    for key, held in contracts.items():
        first = min((shown(r) for r in held), key=lambda g: (g[0] is None, order(g)))
        want[(*key, first[1], first[0], *first[2:], len({r["chassi"] for r in held} - {None}))] += 1
    found = ctr.collateral(make("bens_tb", *rows)).select(
        "nmcont", "cod_cli", "MarcaModelo", "placa", "cor", "AnoFabModelo", "QtdGarantiasUnicas")
    assert Counter(map(tuple, found.collect())) == want


def test_goods_are_made_before_their_sort_and_sorted_by_a_hash(make):
    plan = ctr.collateral(make("bens_tb", {"nmcont": "A", "cod_cli": 517}))._jdf.queryExecution().executedPlan().toString()
    aggregations = [line for line in plan.splitlines() if "SortAggregate" in line]
    assert aggregations and all("SortAggregate(key=[place" in line or "SortAggregate(key=[_group" in line for line in aggregations)
    assert "Generate inline" in plan and "concat" not in "".join(aggregations)


CODES = [{"st": "c", "bsc": "CPC"}, {"st": "s", "bsc": "sistema"}, {"st": "n", "bsc": None}]


def test_contacted(make):
    codes = make("stcob_tb", *CODES)

    def event(account, days_ago, code, operator="U1"):
        return {"cod_cli": account, "data_at": at(days_ago, 0), "ocorr": code, "cod_usu": operator}

    events = make(
        "hist_tb",
        event(1, 30, "c"),
        event(1, 29, "c"),
        event(2, 31, "c"),
        event(3, 1, "s"),
        event(4, 1, "n"),
        event(5, 1, "unknown"),
        event(6, 1, "c", "999"),
        event(7, 1, "c", None),
    )
    day = F.lit(DAY)
    assert pairs(con.contacted(events, codes, day)) == [(1,), (3,)]
    assert pairs(con.contacted(events, codes, day, exclude_system=True)) == [(1,)]
    every = con.contacted(events, codes, day, 31, human_only=False)
    assert pairs(every) == [(n,) for n in range(1, 8)]


def test_last_contact_is_per_contract(make):
    accounts = make(
        "cadastros_tb",
        {"cod_cad": 1, "cod_cli": 517, "nmcont": "A"},
        {"cod_cad": 2, "cod_cli": 517, "nmcont": "A"},
        {"cod_cad": 3, "cod_cli": 518, "nmcont": "A"},
    )
    events = make(
        "hist_tb",
        {"cod_cli": 1, "data_at": at(9), "ocorr": "c"},
        {"cod_cli": 2, "data_at": at(5), "ocorr": "n"},
        {"cod_cli": 2, "data_at": at(1), "ocorr": "unknown"},
        {"cod_cli": 3, "data_at": at(7), "ocorr": "s"},
        {"cod_cli": 8, "data_at": at(0), "ocorr": "c"},
    )
    codes = make("stcob_tb", *CODES)
    assert pairs(con.last_contact(accounts, events, codes)) == [(517, "A", at(5)), (518, "A", at(7))]
    assert pairs(con.last_contact(accounts, events, codes, "cpc")) == [(517, "A", at(9))]
    assert pairs(con.contact_dates(accounts, con.contact_summary(events, codes))) == [
        (517, "A", at(5), at(9)), (518, "A", at(7), None)]


def test_portfolio_summaries(make):
    table = make(
        "cadastros_tb",
        {"cod_cli": 517, "infoad": "b", "stcli": "ATI"},
        {"cod_cli": 517, "infoad": "a", "stcli": "ATI"},
        {"cod_cli": 517, "infoad": "a", "stcli": "ATI"},
        {"cod_cli": 517, "infoad": "a", "stcli": "INA"},
        {"cod_cli": 517, "infoad": "a", "stcli": None},
        {"cod_cli": 517, "infoad": "", "stcli": "ATI"},
        {"cod_cli": 518, "infoad": None, "stcli": "ATI"},
    )
    assert [tuple(r) for r in por.portfolio_counts(table).collect()] == [(517, "a", 2), (517, "b", 1)]
    assert pairs(por.portfolio_total(table, [520, 518, 517])) == [(517, 3), (518, 0), (520, 0)]
    assert [r[0] for r in por.portfolio_labels(table).collect()] == [None, "", "a", "b"]


@pytest.fixture
def base(make):
    """Three accounts of portfolio 517, one per contract, and one of 518."""
    accounts = [
        {"cod_cad": n, "cod_cli": 518 if n == 4 else 517, "nmcont": f"C{n}", "stcli": "ATI",
         "nomecli": f"N{n}", "infoad": f"L{n}", "data_cad": DAY, "data_arq": DAY}
        for n in (1, 2, 3, 4)
    ]
    keys = [{"nmcont": a["nmcont"], "cod_cli": a["cod_cli"]} for a in accounts]
    return {
        "cadastros_tb": make("cadastros_tb", *accounts),
        "fones_tb": make("fones_tb", *[
            {"cod_cad": n, "dddfone": "11", "telefone": f"9123456{n}", "status": 2, "obs": "ok"} for n in (1, 2, 3, 4)]),
        "hist_tb": make("hist_tb", {"cod_cli": 1, "data_at": at(3), "ocorr": "c", "cod_usu": "U"}),
        "stcob_tb": make("stcob_tb", *CODES),
        "acordos_tb": make("acordos_tb", agreement(1, "C1", "Q"), agreement(2, "C2", "P")),
        "rec_comp_tb": make("rec_comp_tb", *[{**k, "int_1": 100, "int_2": 7} for k in keys]),
        "receber_tb": make("receber_tb", *[{**k, "fat_parc": "F1", "vlrparc": Decimal(5)} for k in keys]),
        "bens_tb": make("bens_tb"),
    }


PARAMS = CampaignParams(as_of=DAY, agreements_since=SINCE)


def called(tables, campaign, params=PARAMS):
    return [n for (n,) in pairs(campaign_list(tables, campaign, params).select("cod_cad"))]


def test_who_is_on_which_list(base):
    assert called(base, cat.BROKEN) == [1]
    assert called(base, cat.RIGHT_PERSON) == [1]
    assert called(base, cat.NOT_CONTACTED) == [3, 4]
    assert called(base, cat.WHOLE_BASE) == [1, 3, 4]
    assert called(base, cat.RECENT_BASE) == [1, 3, 4]
    assert called(base, cat.CORE_NOT_CONTACTED) == [3, 4]
    assert called(base, cat.WHOLE_BASE, CampaignParams((518,), as_of=DAY, agreements_since=SINCE)) == [4]


def test_list_columns(base):
    assert campaign_list(base, cat.BROKEN, PARAMS).columns == LIST_COLUMNS
    with_contact = campaign_list(base, cat.WHOLE_BASE, PARAMS, with_last_contact=True)
    assert with_contact.columns == [*LIST_COLUMNS, "dt_ultimo_cpc", "DtUltimoCPC_fmt"]
    shown = {r["cod_cad"]: (r["dt_ultimo_cpc"], r["DtUltimoCPC_fmt"]) for r in with_contact.collect()}
    assert shown[1] == (at(3), "12-02-2024")
    assert shown[3] == (None, None)


def test_an_unnamed_paid_agreement_empties_its_portfolio(base, make):
    base["acordos_tb"] = make("acordos_tb", agreement(1, "C1", "Q"), agreement(5, None, "P"))
    assert called(base, cat.WHOLE_BASE) == [4]
    # Only the newest unnamed agreement counts.
    base["acordos_tb"] = make("acordos_tb", agreement(5, None, "P"), agreement(6, None, "Q"))
    assert called(base, cat.WHOLE_BASE) == [1, 2, 3, 4]
    assert weekly_lists(base, PARAMS).where("campaign = 'geral'").count() == 4


def test_excluded_complement_code_matters_to_core_lists_only(base, make):
    key = {"cod_cli": 517, "nmcont": "C1"}
    base["rec_comp_tb"] = make(
        "rec_comp_tb", {**key, "int_1": 400, "int_2": 9}, {**key, "int_1": None, "int_2": 8})
    assert called(base, cat.BROKEN) == [1]
    assert called(base, cat.CORE_BROKEN) == []
    base["rec_comp_tb"] = make(
        "rec_comp_tb", {**key, "int_1": 400, "int_2": 9}, {**key, "int_1": 100, "int_2": 3})
    assert campaign_list(base, cat.BROKEN, PARAMS).first()["BindingID"] == 9
    assert campaign_list(base, cat.CORE_BROKEN, PARAMS).first()["BindingID"] == 3


@pytest.mark.parametrize("with_last_contact", [False, True])
def test_weekly_lists_equal_single_runs(spark, with_last_contact):
    from testbed.domain import DomainTables
    from testbed.settings import PARAMS as params
    from tests.conftest import SMALL

    tables = DomainTables(spark, SMALL)
    weekly = weekly_lists(tables, params, with_last_contact=with_last_contact).drop("cod_cli").collect()
    for campaign in cat.WEEK:
        single = campaign_list(tables, campaign, params, with_last_contact).collect()
        of_week = [tuple(r)[1:] for r in weekly if r["campaign"] == campaign.id]
        assert sorted(map(str, of_week)) == sorted(str(tuple(r)) for r in single)


def test_core_lists_are_not_part_of_the_week(base):
    with pytest.raises(ValueError):
        weekly_lists(base, PARAMS, [cat.CORE_BROKEN])
    with pytest.raises(ValueError, match="same id"):
        weekly_lists(base, PARAMS, [cat.BROKEN, cat.BROKEN])


def test_weekly_lists_of_one_selector_equal_single_runs(spark):
    from testbed.domain import DomainTables
    from tests.conftest import SMALL

    tables = DomainTables(spark, SMALL)
    lists = [cat.NOT_CONTACTED, replace(cat.NOT_CONTACTED, id="nunca_20", contact_days=20),
             replace(cat.NOT_CONTACTED, id="nunca_any", contact_days=60, human_only=False)]
    weekly = weekly_lists(tables, PARAMS, lists).drop("cod_cli").collect()
    sizes = set()
    for campaign in lists:
        single = campaign_list(tables, campaign, PARAMS).collect()
        of_week = [tuple(r)[1:] for r in weekly if r["campaign"] == campaign.id]
        assert Counter(of_week) == Counter(map(tuple, single))
        sizes.add(len(single))
    assert len(sizes) == 3


def test_contact_summary(make):
    codes = make("stcob_tb", *CODES)
    events = make(
        "hist_tb",
        {"cod_cli": 1, "data_at": at(9), "ocorr": "c", "cod_usu": "U1"},
        {"cod_cli": 1, "data_at": at(8), "ocorr": "c", "cod_usu": "999"},
        {"cod_cli": 1, "data_at": at(7), "ocorr": "s", "cod_usu": "U1"},
        {"cod_cli": 1, "data_at": at(6), "ocorr": "n", "cod_usu": "U1"},
        {"cod_cli": 1, "data_at": at(5), "ocorr": "unknown", "cod_usu": "U1"},
    )
    (row,) = con.contact_summary(events, codes).collect()
    assert row["seen"] == [at(5), at(6), at(8), at(7)]
    (row,) = con.contact_summary(events, codes, exclude_system=True).collect()
    assert row["seen"] == [at(5), at(6), at(8), at(9)]
