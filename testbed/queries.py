"""One query per operator, over the tables of :mod:`testbed.domain`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.functions.agreement import BROKEN as BROKEN_STATUS
from callsheet.functions.agreement import SETTLED
from callsheet.functions.amounts import parse_br_amount
from callsheet.functions.phone import has_digit_run
from callsheet.operators import accounts as acc
from callsheet.operators import agreements as agr
from callsheet.operators import contacts as con
from callsheet.operators import contracts as ctr
from callsheet.operators import phones as pho
from callsheet.operators import portfolios as por
from callsheet.params import REPEATED_DIGIT, REPEATED_DIGIT_LITERAL
from callsheet.plans import catalogue as cat
from callsheet.plans.campaigns import campaign_list, weekly_lists
from callsheet.schemas import SCHEMAS
from callsheet.sinks.chunks import chunked
from callsheet.sinks.csv import to_text
from callsheet.sinks.files import work_folder
from callsheet.sinks.names import export_name
from callsheet.sources.bound import accounts_from_sql
from testbed.domain import DomainTables
from testbed.settings import FILTERED, LABELS, LITERAL, MIN_SUM, PARAMS, SCANS

Tables = dict[str, DataFrame]
SINCE = PARAMS.agreements_since


def _base(t: Tables) -> DataFrame:
    return acc.select_accounts(t["cadastros_tb"], PARAMS)


def _newest(t: Tables) -> DataFrame:
    return agr.newest_agreement(t["acordos_tb"], SINCE)


def _paid(t: Tables) -> DataFrame:
    return agr.contracts_in_status(_newest(t), SETTLED)


def _blocked(t: Tables) -> Tables:
    """The tables with settled agreements of portfolio 519 that have no contract number."""
    settled = F.col("staco").isin(*SETTLED)
    without = (F.col("cod_cli") == 519) & settled & (F.col("cod_aco") % 5 == 0)
    agreements = t["acordos_tb"].withColumn("nmcont", F.when(~without, F.col("nmcont")))
    return {**{name: t[name] for name in SCHEMAS}, "acordos_tb": agreements}


def _clean(t: Tables, rule: str) -> DataFrame:
    base = _base(t)
    if rule == "core":
        base = ctr.with_core_complement(base, t["rec_comp_tb"])
    return pho.phones_of(base, pho.clean_phones(t["fones_tb"], rule))


def _ranked(t: Tables) -> DataFrame:
    return pho.phones_of(_base(t), pho.rank_phones(pho.clean_phones(t["fones_tb"], "strict")))


def _wide(t: Tables) -> DataFrame:
    top = pho.top_phones(pho.clean_phones(t["fones_tb"], "strict"), PARAMS.max_phones)
    return pho.widen_phones(top)


def _without_run(t: Tables, pattern: str) -> DataFrame:
    numbered = pho.number_phones(t["fones_tb"])
    kept = numbered.where(~has_digit_run(F.col("telefone_completo"), pattern))
    return kept.select("cod_cad", "telefone_completo")


def _values(t: Tables, **options) -> DataFrame:
    return agr.exclude_paid(
        ctr.contract_values(t["rec_comp_tb"], t["receber_tb"], **options), _paid(t), PARAMS.portfolios
    )


def _contacted(t: Tables, **options) -> DataFrame:
    return con.contacted(t["hist_tb"], t["stcob_tb"], PARAMS.today, **options)


_CORE_CONTACT = {"days": 60, "human_only": False}


def _last(t: Tables, only: str | None) -> DataFrame:
    return con.last_contact(_base(t), t["hist_tb"], t["stcob_tb"], only)


def _listed(t: Tables) -> DataFrame:
    """Accounts on a strict list, with their contract key."""
    return _base(t).select("cod_cad", "cod_cli", "nmcont").join(_wide(t).select("cod_cad"), "cod_cad")


def _enriched(t: Tables, facts: DataFrame) -> DataFrame:
    return acc.join_contracts(_listed(t), facts, "left").drop("cod_cli", "nmcont")


def _campaign(campaign: cat.Campaign, params=PARAMS, **options):
    return lambda t: campaign_list(t, campaign, params, **options)


def _export_names(t: Tables) -> DataFrame:
    """A list per portfolio, label and load day, for the campaign due that day."""
    days = t["cadastros_tb"].select("cod_cli", "infoad", "data_cad").distinct()
    due = cat.campaign_calendar(days.select(F.col("data_cad").alias("date")).distinct())
    jobs = days.join(due.where("campaign IS NOT NULL"), F.col("data_cad") == F.col("date"))
    labels = F.array_compact(F.array("infoad"))
    at = F.col("data_cad").cast("timestamp_ntz")
    name = export_name(F.col("cod_cli"), F.col("campaign"), labels, at)
    return jobs.select("cod_cli", "campaign", name.alias("file_name"))


def _amount_texts(orders: DataFrame) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole = F.floor(cents / 100).cast("bigint")
    part = F.lpad((cents % 100).cast("string"), 2, "0")
    high = F.floor(whole / 1000).cast("string")
    low = F.lpad((whole % 1000).cast("string"), 3, "0")
    comma, point, unit = F.lit(","), F.lit("."), whole.cast("string")
    kind = F.col("o_orderkey") % 8
    return orders.select(
        F.when(kind == 0, F.concat(unit, comma, part))
        .when(kind == 1, F.concat(high, point, low, comma, part))
        .when(kind == 2, F.concat(high, point, low))
        .when(kind == 3, F.concat(unit, F.lit("00000000000000")))
        .when(kind == 4, F.concat(high, comma, low, comma, part))
        .when(kind == 5, F.concat(F.lit("  "), unit, point, part, F.lit("5 ")))
        .when((kind == 6) & (F.col("o_custkey") % 2 == 0), "")
        .when(kind == 6, "nan")
        .otherwise(F.concat(F.lit("-"), unit, F.lit("e1")))
        .alias("raw")
    )


def _chunks(t: Tables) -> DataFrame:
    """All receivables in chunks of 5000 for each portfolio."""
    rows = t["receber_tb"].select("cod_cli", "nmcont", "fat_parc", "vlrparc")
    order = ["nmcont", "fat_parc", "vlrparc"]
    return chunked(rows, ["cod_cli"], work_folder(rows.sparkSession, "chunks"), order=order).drop("first_row", "rows")


#: Accounts of a list as SQL text; the labels of the test data hold quotes.
ACCOUNTS_SQL = """
SELECT cod_cad FROM {cadastros_tb}
WHERE array_contains(:portfolios, cod_cli) AND stcli <> 'INA' AND array_contains(:labels, infoad)
"""


def _from_sql(t: Tables) -> DataFrame:
    spark = t["cadastros_tb"].sparkSession
    values = {"portfolios": FILTERED.portfolios, "labels": FILTERED.labels}
    chosen = accounts_from_sql(spark, ACCOUNTS_SQL, {name: t[name] for name in SCHEMAS}, values)
    return campaign_list(chosen, cat.WHOLE_BASE, replace(FILTERED, labels=()))


def _scan(table: str):
    return lambda t: t[table]


#: Queries over the eight tables.
DOMAIN_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    **{name: _scan(table) for name, table in SCANS.items()},
    "filter_portfolio": lambda t: acc.in_portfolio(t["cadastros_tb"], [518]).select(
        "cod_cad", "nmcont", "cod_cli"
    ),
    "filter_active": lambda t: acc.active(t["cadastros_tb"]).select("cod_cad", "stcli"),
    "filter_infoad": lambda t: acc.with_labels(t["cadastros_tb"], LABELS).select("cod_cad", "infoad"),
    "recent_accounts": lambda t: acc.recent_accounts(t["cadastros_tb"], PARAMS.today).select(
        "cod_cad", "data_cad"
    ),
    "phones_strict": lambda t: _clean(t, "strict").select("cod_cad", "telefone_completo", "status"),
    "phones_loose": lambda t: _clean(t, "loose").select("cod_cad", "telefone_completo", "status"),
    "phones_core": lambda t: _clean(t, "core").select("cod_cad", "telefone_completo", "status"),
    "phones_no_repeat": lambda t: _without_run(t, REPEATED_DIGIT),
    "phones_no_repeat_literal": lambda t: _without_run(t, REPEATED_DIGIT_LITERAL),
    "binding_id": lambda t: ctr.binding_id(_base(t), t["rec_comp_tb"]).select("cod_cad", "BindingID"),
    "phones_ranked": lambda t: _ranked(t).select("cod_cad", "telefone_completo", "status", "num"),
    "phones_topk": lambda t: pho.phones_of(
        _base(t), pho.top_phones(pho.clean_phones(t["fones_tb"], "strict"), 3)
    ).select("cod_cad", "telefone_completo", "status", "num"),
    "phones_wide": lambda t: _base(t).select("cod_cad").join(_wide(t), "cod_cad"),
    "agreements_ranked": lambda t: agr.rank_agreements(t["acordos_tb"], SINCE).select(
        "cod_cli", "nmcont", "cod_aco", "staco", "rn_aco"
    ),
    "latest_agreement": lambda t: agr.latest_agreement(t["acordos_tb"], SINCE),
    "paid_contracts": _paid,
    "broken_contracts": lambda t: agr.contracts_in_status(_newest(t), BROKEN_STATUS),
    "unpaid_contracts": lambda t: ctr.unpaid_contracts(
        t["rec_comp_tb"], _paid(t), PARAMS.portfolios
    ),
    "unpaid_contracts_blocked": lambda t: ctr.unpaid_contracts(
        t["rec_comp_tb"], _paid(_blocked(t)), PARAMS.portfolios
    ),
    "contract_values": lambda t: _values(t).select("cod_cli", "nmcont", "Contratos", "TipoProduto"),
    "contract_values_min": lambda t: _values(t, min_sum=Decimal(MIN_SUM)).select(
        "cod_cli", "nmcont", "Contratos", "TipoProduto", "soma"
    ),
    "contract_values_single_sum": lambda t: _values(t, dedupe_sum=True).select(
        "cod_cli", "nmcont", "soma"
    ),
    "collateral": lambda t: ctr.collateral(t["bens_tb"]),
    "last_contact": lambda t: _last(t, None),
    "last_cpc": lambda t: _last(t, con.RIGHT_PERSON),
    "contacted_30d": _contacted,
    "contacted_30d_no_system": lambda t: _contacted(t, exclude_system=True),
    "contacted_60d_core": lambda t: _contacted(t, **_CORE_CONTACT),
    "not_contacted_30d": lambda t: con.not_contacted(_base(t), _contacted(t)).select("cod_cad"),
    "not_contacted_60d_core": lambda t: con.not_contacted(
        _base(t), _contacted(t, **_CORE_CONTACT)
    ).select("cod_cad"),
    "list_with_collateral": lambda t: _enriched(t, ctr.collateral(t["bens_tb"])),
    "list_with_agreement": lambda t: _enriched(t, agr.latest_agreement(t["acordos_tb"], SINCE)),
    "campaign_quebras": _campaign(cat.BROKEN),
    "campaign_cpc": _campaign(cat.RIGHT_PERSON),
    "campaign_nunca": _campaign(cat.NOT_CONTACTED),
    "campaign_geral": _campaign(cat.WHOLE_BASE),
    "campaign_recentes": _campaign(cat.RECENT_BASE),
    "campaign_geral_contact": _campaign(cat.WHOLE_BASE, with_last_contact=True),
    "campaign_recentes_contact": _campaign(cat.RECENT_BASE, with_last_contact=True),
    "campaign_quebras_core": _campaign(cat.CORE_BROKEN),
    "campaign_cpc_core": _campaign(cat.CORE_RIGHT_PERSON),
    "campaign_nunca_core": _campaign(cat.CORE_NOT_CONTACTED),
    "campaign_geral_filtered": _campaign(cat.WHOLE_BASE, FILTERED),
    "campaign_geral_literal": _campaign(cat.WHOLE_BASE, LITERAL),
    "campaign_geral_blocked": lambda t: campaign_list(_blocked(t), cat.WHOLE_BASE, PARAMS),
    "weekly_lists_windows": lambda t: weekly_lists(
        t, PARAMS, [cat.NOT_CONTACTED, replace(cat.NOT_CONTACTED, id="nunca_45", contact_days=45)]
    ),
    "weekly_lists": lambda t: weekly_lists(t, PARAMS),
    "weekly_lists_contact": lambda t: weekly_lists(t, PARAMS, with_last_contact=True),
    "portfolio_counts": lambda t: por.portfolio_counts(t["cadastros_tb"]),
    "portfolio_total": lambda t: por.portfolio_total(t["cadastros_tb"], (*PARAMS.portfolios, 520)),
    "portfolio_labels": lambda t: por.portfolio_labels(
        acc.in_portfolio(t["cadastros_tb"], PARAMS.portfolios)
    ),
    "portfolio_summary": lambda t: por.portfolio_summary(
        t["cadastros_tb"], (*PARAMS.portfolios, 520)
    ),
    "campaign_geral_sql": _from_sql,
    "export_names": _export_names,
    "export_chunks": _chunks,
    "export_csv_rows": lambda t: to_text(campaign_list(t, cat.WHOLE_BASE, PARAMS)),
}


def _parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _amount_texts(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return texts.withColumn("amount", parse_br_amount(F.col("raw")))


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return cat.campaign_calendar(orders.select(F.col("o_orderdate").cast("date").alias("date")).distinct())


def _over_domain(build: Callable[[Tables], DataFrame]):
    return lambda spark, sf_dir: build(DomainTables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name: _over_domain(build) for name, build in DOMAIN_QUERIES.items()}
    return {**named, "parse_amounts": _parse_amounts, "campaign_calendar": _calendar}
