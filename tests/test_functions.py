import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from callsheet.functions.agreement import payment_kind, status_label
from callsheet.functions.amounts import parse_br_amount
from callsheet.functions.phone import dial_priority, full_number, has_digit_run, phone_rule
from callsheet.operators.accounts import is_recent
from callsheet.operators.phones import number_phones
from callsheet.params import REPEATED_DIGIT_LITERAL, CampaignParams
from callsheet.plans.catalogue import campaign_calendar
from callsheet.sinks.names import export_name


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [row[0] for row in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_amounts(spark):
    texts = ["1.234,56", "1234,5", "10.000", "10000", "1,234,567", "", None, "nan", "inf", "12d",
             "1e5", " 7 ", "\t8,5\n", "0.125", "2.675", "-3,1", "1.2.3", "1.234.567,891", "abc",
             "1e17", "99.999.999.999.999.999,00", "-12e20", "1e40", "+5", "-", ".5", "5.", "1e", "--1", ",",
             "0,005", "0,015", "7,", "1_0", "1 0"]
    want = ["1234.56", "1234.50", "10.00", "10000.00", None, None, None, None, None, None,
            "100000.00", "7.00", "8.50", "0.12", "2.67", "-3.10", None, "1234567.89", None,
            "100000000000000000.00", "100000000000000000.00", "-1200000000000000000000.00", None, "5.00", None,
            "0.50", "5.00", None, None, None, "0.01", "0.01", "7.00", None, None]
    got = column(spark, texts, "string", parse_br_amount)
    assert got == [None if w is None else Decimal(w) for w in want]


def test_strict_amounts_fail_on_bad_text_only(spark):
    assert column(spark, ["1,5", "", None], "string", lambda c: parse_br_amount(c, strict=True)) == [
        Decimal("1.50"), None, None]
    with pytest.raises(PySparkException, match="not an amount: x1"):
        column(spark, ["x1"], "string", lambda c: parse_br_amount(c, strict=True))
    with pytest.raises(PySparkException, match="amount too large: 1e40"):
        column(spark, ["1e40"], "string", lambda c: parse_br_amount(c, strict=True))


def test_unlisted_statuses_come_first(spark):
    statuses = [2, 4, 5, 6, 1, 0, 3, 7, None]
    assert column(spark, statuses, "int", dial_priority) == [1, 2, 3, 4, 5, 6, 0, 0, 0]


def test_digit_runs(spark):
    numbers = ["11911111123", "1191111112", "11" + "1111" + "22", "1199999912", "119912345", None]
    assert column(spark, numbers, "string", has_digit_run) == [True, True, True, True, False, None]
    literal = [n for n in ("9111110", "1199999912", "111111")]
    got = column(spark, literal, "string", lambda c: has_digit_run(c, REPEATED_DIGIT_LITERAL))
    assert got == [True, False, True]


def test_missing_area_code_makes_the_number_missing(spark):
    df = spark.createDataFrame([("11", "9"), (None, "9"), ("11", None)], "dddfone string, telefone string")
    assert [r[0] for r in df.select(full_number()).collect()] == ["119", None, None]


def phones_passing(make, rule, *rows):
    df = number_phones(make("fones_tb", *[{"cod_cad": i, **r} for i, r in enumerate(rows)]))
    return [r["cod_cad"] for r in df.where(phone_rule(rule)).orderBy("cod_cad").collect()]


GOOD = {"dddfone": "11", "telefone": "91234567"}
PHONES = [
    {**GOOD, "status": 2, "obs": None},  # trusted status, no note
    {**GOOD, "status": 3, "obs": None},  # other status, no note
    {**GOOD, "status": 3, "obs": "ok"},
    {**GOOD, "status": 3, "obs": "DESCONTINUADO"},
    {**GOOD, "status": 2, "obs": "desconhecido"},  # bad note on a trusted status
    {**GOOD, "status": None, "obs": "ok"},
    {"dddfone": "11", "telefone": "12345", "status": 2, "obs": "ok"},  # 7 characters
    {"dddfone": "11", "telefone": "9x234567", "status": 2, "obs": "ok"},
    {"dddfone": "11", "telefone": "99999990", "status": 2, "obs": "ok"},  # digit run
    {"dddfone": None, "telefone": "91234567", "status": 2, "obs": "ok"},
]


def test_phone_rules(make):
    assert phones_passing(make, "strict", *PHONES) == [0, 2, 4, 5]
    assert phones_passing(make, "loose", *PHONES) == [0, 1, 2, 3, 4, 5, 6, 7]
    # The core rule drops missing notes, and digit runs pass.
    assert phones_passing(make, "core", *PHONES) == [2, 5, 8]


def test_length_counts_bytes(make):
    assert phones_passing(make, "strict", {"dddfone": "1", "telefone": "2345é7", "status": 2}) == [0]


def test_months_clamp_to_the_end_of_february(spark, make):
    days = [dt.date(2024, 2, 28), dt.date(2024, 2, 29), dt.date(2024, 3, 1)]
    df = make("cadastros_tb", *[{"cod_cad": i, "data_cad": d, "data_arq": d} for i, d in enumerate(days)])
    got = df.where(is_recent(F.lit(dt.date(2024, 4, 30)))).orderBy("cod_cad").collect()
    assert [r["cod_cad"] for r in got] == [1, 2]


def test_agreement_labels(spark):
    assert column(spark, list("AEGQPC") + [None], "string", status_label) == [
        "Em Acordo", "Exceção Rejeitada", "Pago", "Quebrado", "Em Promessa", "Sem Dados", "Sem Dados"]
    assert column(spark, [0, 1, 2, None], "int", payment_kind) == [None, "AVISTA", "PARCELADO", None]


def test_calendar(spark):
    monday = dt.date(2024, 2, 12)
    df = spark.createDataFrame([(monday + dt.timedelta(days=i),) for i in range(7)], "date date")
    got = {r["weekday"]: r["campaign"] for r in campaign_calendar(df).collect()}
    assert got == {
        0: "seg_quebras_rcs", 1: "ter_cpc", 2: "qua_nunca_contatados", 3: "geral", 4: "base_recente",
        5: None, 6: None}


def test_export_names(spark):
    at = dt.datetime(2025, 1, 1, 10, 15, 0)
    rows = [
        (517, "seg_quebras_rcs", None, at),
        (518, "ter_cpc", [], at),
        (517, "geral", ["Bradesco IV", "Bradesco VII"], at),
        (519, "qua_nunca_contatados", ["--"], at),
        (520, "other", ["Ação 1"], at),
    ]
    df = spark.createDataFrame(rows, "c int, m string, l array<string>, t timestamp_ntz")
    got = [r[0] for r in df.select(export_name(*[F.col(c) for c in "cmlt"])).collect()]
    assert got == [
        "AutosPF_QuebrasRejeitadas_20250101_101500",
        "DivZeroPF_CPC_20250101_101500",
        "AutosPF_Geral_BradescoIV_BradescoVII_20250101_101500",
        "CedidasPF_NuncaContatados_Infoad_20250101_101500",
        "AutosPF_other_Ação1_20250101_101500",
    ]


def test_params():
    assert CampaignParams(max_phones=9).max_phones == 7
    assert CampaignParams(max_phones=0).max_phones == 1
    assert CampaignParams(min_sum=0.125).min_sum == Decimal("0.12")
    with pytest.raises(ValueError):
        CampaignParams(portfolios=())
