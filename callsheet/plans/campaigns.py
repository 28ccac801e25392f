"""Campaign lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.functions.text import day_text
from callsheet.operators.accounts import (
    account_columns,
    is_recent,
    join_contracts,
    recent_accounts,
    select_accounts,
)
from callsheet.operators.contacts import (
    ANY_EVENT,
    HUMAN,
    RIGHT_PERSON,
    contact_dates,
    contact_summary,
    contacted,
    last_contact,
    not_contacted,
    window_start,
)
from callsheet.operators.contracts import contract_profile
from callsheet.operators.phones import clean_phones_by_rule, phone_lists_by_rule, slot_names
from callsheet.params import CampaignParams
from callsheet.plans.catalogue import PORTFOLIOS, WEEK, Campaign
from callsheet.schemas import CONTRACT, SCHEMAS
from callsheet.session import require_adaptive

ACCOUNT_COLUMNS = ["cod_cad", "nome", "cpf", "BindingID", "DataNascimento", "Portfolio"]
CONTRACT_COLUMNS = [
    "MarcaModelo",
    "placa",
    "cor",
    "AnoFabModelo",
    "QtdGarantiasUnicas",
    "Contratos",
    "TipoProduto",
    "UltimoValorAcordado",
    "TipoAcordo",
    "DataCriacaoGecobi",
    "StatusUltimoAcordo",
]
LIST_COLUMNS = [*ACCOUNT_COLUMNS, *slot_names(), *CONTRACT_COLUMNS]

#: Lists whose last contact is the last one with the right person.
_RIGHT_PERSON_DATES = ("right_person", "not_contacted")


def _contact_columns() -> list[Column]:
    at = F.col("dt_ultimo_cpc")
    return [at, day_text(at).alias("DtUltimoCPC_fmt")]


def _window(campaign: Campaign, params: CampaignParams) -> int:
    return params.contact_days if campaign.contact_days is None else campaign.contact_days


def _recent_contacts(tables: dict[str, DataFrame], campaign: Campaign, params: CampaignParams):
    return contacted(
        tables["hist_tb"],
        tables["stcob_tb"],
        params.today,
        _window(campaign, params),
        campaign.human_only,
        params.exclude_system_events,
    )


def campaign_list(
    tables: dict[str, DataFrame],
    campaign: Campaign,
    params: CampaignParams,
    with_last_contact: bool = False,
    with_keys: bool = False,
) -> DataFrame:
    """One row per account to call, in the column order of :data:`LIST_COLUMNS`.

    ``with_keys`` puts ``campaign`` and ``cod_cli`` in front, as :func:`weekly_lists` does.

    Accounts, contacts and phones meet on the account id, the result meets the
    contract profile last. Each side is down to one row per key by then, except for
    accounts that share a contract.
    """
    base = select_accounts(tables["cadastros_tb"], params)
    require_adaptive(base.sparkSession)
    tables = selected_tables(tables, base, params)
    history = tables["hist_tb"], tables["stcob_tb"]
    profile = contract_profile(tables, params)
    accounts = base

    if campaign.selects == "broken":
        profile = profile.where("is_broken")
    elif campaign.selects == "not_contacted":
        accounts = not_contacted(accounts, _recent_contacts(tables, campaign, params))
    elif campaign.selects == "recent":
        accounts = recent_accounts(accounts, params.today, params.recent_months)

    only = RIGHT_PERSON if campaign.selects in _RIGHT_PERSON_DATES else None
    if with_last_contact:
        how = "inner" if campaign.selects == "right_person" else "left"
        profile = profile.join(last_contact(base, *history, only), CONTRACT, how)
    elif campaign.selects == "right_person":
        profile = profile.join(last_contact(base, *history, only), CONTRACT, "left_semi")

    if campaign.is_core:
        # A code other than the excluded one on at least one complement row.
        profile = profile.where(F.col("core_rows") > 0)
        profile = profile.withColumn("BindingID", F.col("core_BindingID"))

    rule = campaign.phone_rule
    cleaned = clean_phones_by_rule(tables["fones_tb"], [rule], params.repeated_digits)
    numbers = phone_lists_by_rule(cleaned, [rule], params.max_phones)
    phones = numbers.select(
        "cod_cad", *[F.get(rule, F.lit(i)).alias(name) for i, name in enumerate(slot_names())]
    )

    listed = join_contracts(accounts.select(*account_columns()).join(phones, "cod_cad"), profile)
    keys = [F.lit(campaign.id).alias("campaign"), "cod_cli"] if with_keys else []
    return listed.select(*keys, *LIST_COLUMNS, *(_contact_columns() if with_last_contact else []))


def selected_tables(
    tables: dict[str, DataFrame], accounts: DataFrame, params: CampaignParams
) -> dict[str, DataFrame]:
    """The tables cut down to the selected ``accounts`` of a selective run.

    A run for some labels or portfolios looks at few of the phones, events and contract
    rows; they fall away before anything is ranked or reduced. Agreements stay whole:
    one without a contract number decides about its portfolio.
    """
    if not params.labels and len(params.portfolios) == len(PORTFOLIOS):
        return tables
    cut = {name: tables[name] for name in SCHEMAS}
    cut["fones_tb"] = tables["fones_tb"].join(accounts.select("cod_cad"), "cod_cad", "left_semi")
    known = accounts.select(F.col("cod_cad").alias("cod_cli"))
    cut["hist_tb"] = tables["hist_tb"].join(known, "cod_cli", "left_semi")
    if params.labels:
        contracts = accounts.select(*CONTRACT).distinct()
        for name in ("rec_comp_tb", "receber_tb", "bens_tb"):
            cut[name] = tables[name].join(contracts, CONTRACT, "left_semi")
    return cut


def _member(campaign: Campaign, params: CampaignParams) -> Column:
    """Whether a row of the joined account frame is on the campaign's list."""
    has_phone = F.size(campaign.phone_rule) > 0
    if campaign.selects == "broken":
        return has_phone & F.col("is_broken")
    if campaign.selects == "right_person":
        return has_phone & F.col("last_right").isNotNull()
    if campaign.selects == "not_contacted":
        last = F.get("seen", F.lit(HUMAN if campaign.human_only else ANY_EVENT))
        contacted_ = last >= window_start(params.today, _window(campaign, params))
        return has_phone & ~F.coalesce(contacted_, F.lit(False))
    if campaign.selects == "recent":
        return has_phone & F.col("recent")
    return has_phone


def weekly_lists(
    tables: dict[str, DataFrame],
    params: CampaignParams,
    campaigns: Sequence[Campaign] = WEEK,
    with_last_contact: bool = False,
) -> DataFrame:
    """The lists of all ``campaigns`` and portfolios, with ``campaign`` and ``cod_cli`` in front.

    Phones, agreements, contract texts and collateral are worked out once for all
    lists, and events once for all their conditions. Accounts travel once, whatever
    number of lists they are on, and are copied per list only after the last shuffle.
    Campaigns may differ in anything but their id.
    """
    if any(c.is_core for c in campaigns):
        raise ValueError("core lists run one at a time")
    if len({c.id for c in campaigns}) < len(campaigns):
        raise ValueError("two campaigns have the same id")
    uses = {c.selects for c in campaigns}
    rules = sorted({c.phone_rule for c in campaigns})

    accounts = select_accounts(tables["cadastros_tb"], params)
    require_adaptive(accounts.sparkSession)
    tables = selected_tables(tables, accounts, params)
    base = accounts.select(
        *account_columns(), is_recent(params.today, params.recent_months).alias("recent")
    )
    needs_dates = with_last_contact or "right_person" in uses
    if needs_dates or "not_contacted" in uses:
        events = tables["hist_tb"]
        if not needs_dates:
            longest = max(_window(c, params) for c in campaigns if c.selects == "not_contacted")
            events = events.where(F.col("data_at") >= window_start(params.today, longest))
        summary = contact_summary(events, tables["stcob_tb"], params.exclude_system_events)
    if "not_contacted" in uses:
        base = base.join(summary, "cod_cad", "left")

    cleaned = clean_phones_by_rule(tables["fones_tb"], rules, params.repeated_digits)
    base = base.join(phone_lists_by_rule(cleaned, rules, params.max_phones), "cod_cad")

    profile = contract_profile(tables, params)
    if needs_dates:
        profile = profile.join(contact_dates(accounts, summary), CONTRACT, "left")

    on_lists = F.array_compact(
        F.array(*[F.when(_member(c, params), F.lit(c.id)) for c in campaigns])
    )
    listed = join_contracts(base, profile).withColumn("campaign", F.explode(on_lists))

    numbers = _by_campaign({c.id: F.col(c.phone_rule) for c in campaigns})
    phones = [F.get(numbers, F.lit(i)).alias(name) for i, name in enumerate(slot_names())]
    extra = []
    if with_last_contact:
        kinds = {
            c.id: F.col("last_right" if c.selects in _RIGHT_PERSON_DATES else "last_any")
            for c in campaigns
        }
        listed = listed.withColumn("dt_ultimo_cpc", _by_campaign(kinds))
        extra = _contact_columns()
    return listed.select("campaign", "cod_cli", *ACCOUNT_COLUMNS, *phones, *CONTRACT_COLUMNS, *extra)


def _by_campaign(values: dict[str, Column]) -> Column:
    """The value of the row's campaign."""
    return F.coalesce(*[F.when(F.col("campaign") == id_, value) for id_, value in values.items()])
