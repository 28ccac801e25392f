"""Properties of whole results."""

from collections import defaultdict

import pytest

from callsheet.operators.phones import slot_names
from callsheet.plans.campaigns import campaign_list, weekly_lists
from callsheet.plans.catalogue import CORE, WHOLE_BASE
from testbed.domain import DomainTables
from testbed.settings import FILTERED, PARAMS
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def week(spark):
    return weekly_lists(DomainTables(spark, SMALL), PARAMS).collect()


def test_an_account_is_once_on_a_list(week):
    assert len({(r["campaign"], r["cod_cad"]) for r in week}) == len(week)


def test_phone_slots_fill_from_the_left(week):
    for row in week:
        filled = [row[name] is not None for name in slot_names()]
        assert filled[0] and filled == sorted(filled, reverse=True)


def test_paid_contracts_are_on_no_list(week):
    labels = {r["StatusUltimoAcordo"] for r in week}
    assert labels == {"Quebrado", "Exceção Rejeitada", None}
    assert None not in {r["StatusUltimoAcordo"] for r in week if r["campaign"] == "seg_quebras_rcs"}


def test_every_list_is_part_of_the_whole_base(spark, week):
    listed = defaultdict(set)
    for row in week:
        listed[row["campaign"]].add(row["cod_cad"])
    assert all(accounts <= listed["geral"] for accounts in listed.values())
    core = campaign_list(DomainTables(spark, SMALL), CORE[0], PARAMS).collect()
    assert {r["cod_cad"] for r in core} and len(core) == len({r["cod_cad"] for r in core})


def test_no_phone_beyond_the_number_asked_for(spark):
    rows = campaign_list(DomainTables(spark, SMALL), WHOLE_BASE, FILTERED).collect()
    assert rows and all(r[name] is None for r in rows for name in slot_names()[3:])
