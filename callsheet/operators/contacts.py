"""Contact history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.schemas import CONTRACT

#: Class text of a contact with the right person (fixed value).
RIGHT_PERSON = "CPC"
#: Class text of system events (fixed value).
SYSTEM_CLASS = "sistema"
#: Operator id of the system (fixed value).
SYSTEM_OPERATOR = "999"


#: Places in the array of :func:`contact_summary`.
ANY_EVENT, ANY_CODE, RIGHT, HUMAN = range(4)


def _by_code(events: DataFrame) -> DataFrame:
    """Latest event, and latest one by an operator, per account and event code.

    Events meet the codes only after this. Accounts times codes is all that moves, and
    no shuffle of events is by the code alone, of which there are a handful.
    """
    at = F.col("data_at")
    return events.groupBy(F.col("cod_cli").alias("cod_cad"), "ocorr").agg(
        F.max(at).alias("at"),
        F.max(F.when(F.col("cod_usu") != SYSTEM_OPERATOR, at)).alias("human_at"),
    )


def _has_class(exclude_system: bool) -> Column:
    """Whether a code has a class that makes an operator's event a contact."""
    if not exclude_system:
        return F.col("bsc").isNotNull()
    return (F.col("bsc") != "") & ~F.col("bsc").ilike(f"%{SYSTEM_CLASS}%")


def _is_right_person() -> Column:
    return F.col("bsc").ilike(f"%{RIGHT_PERSON}%")


def contact_summary(events: DataFrame, codes: DataFrame, exclude_system: bool = False) -> DataFrame:
    """Per account an array ``seen`` of four latest events: any, with a known code, with the
    right person, and by an operator under a code with a class.

    One array, so that all uses of it in a plan are the same and Spark works it out once.
    """
    known = F.col("st").isNotNull()
    latest = [
        F.max("at"),
        F.max(F.when(known, F.col("at"))),
        F.max(F.when(known & _is_right_person(), F.col("at"))),
        F.max(F.when(known & _has_class(exclude_system), F.col("human_at"))),
    ]
    reduced = _by_code(events)
    return (
        reduced.join(codes, reduced["ocorr"] == codes["st"], "left")
        .groupBy("cod_cad")
        .agg(F.array(*latest).alias("seen"))
    )


def last_contact(
    accounts: DataFrame, events: DataFrame, codes: DataFrame, only: str | None = None
) -> DataFrame:
    """Latest contact per contract over its ``accounts``; ``only`` limits the event class."""
    if only is not None:
        codes = codes.where(F.col("bsc").ilike(f"%{only}%"))
    reduced = _by_code(events)
    dates = reduced.join(codes, reduced["ocorr"] == codes["st"]).groupBy("cod_cad").agg(F.max("at").alias("at"))
    by_contract = accounts.join(dates, "cod_cad").groupBy(*CONTRACT)
    return by_contract.agg(F.max("at").alias("dt_ultimo_cpc"))


def contact_dates(accounts: DataFrame, summary: DataFrame) -> DataFrame:
    """Per contract: latest contact of any class and with the right person."""
    by_contract = accounts.join(summary, "cod_cad").groupBy(*CONTRACT)
    return by_contract.agg(
        F.max(F.get("seen", F.lit(ANY_CODE))).alias("last_any"),
        F.max(F.get("seen", F.lit(RIGHT))).alias("last_right"),
    )


def window_start(as_of: Column, days: int) -> Column:
    """First moment of a contact window; a plain timestamp, so no session time zone gets in."""
    return F.date_sub(as_of, days).cast("timestamp_ntz")


def contacted(
    events: DataFrame,
    codes: DataFrame,
    as_of: Column,
    days: int = 30,
    human_only: bool = True,
    exclude_system: bool = False,
) -> DataFrame:
    """Accounts with an event in the last ``days`` days.

    ``human_only`` wants an operator other than the system and a code with a class;
    system classes count unless ``exclude_system``. Without it any event counts.
    """
    recent = events.where(F.col("data_at") >= window_start(as_of, days))
    if not human_only:
        return recent.select(F.col("cod_cli").alias("cod_cad")).distinct()
    by_operator = recent.where(F.col("cod_usu") != SYSTEM_OPERATOR)
    pairs = by_operator.select(F.col("cod_cli").alias("cod_cad"), "ocorr").distinct()
    classed = codes.where(_has_class(exclude_system))
    return pairs.join(classed, pairs["ocorr"] == classed["st"], "left_semi").select("cod_cad").distinct()


def not_contacted(accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    return accounts.join(contacts, "cod_cad", "left_anti")
