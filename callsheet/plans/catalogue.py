"""Campaigns and portfolios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Campaign:
    """Who gets on a list.

    ``selects`` is one of ``broken``, ``right_person``, ``not_contacted``, ``all``
    and ``recent``; ``phone_rule`` a rule of :func:`callsheet.functions.phone.phone_rule`.
    ``contact_days`` overrides the run's parameter, and without ``human_only`` any
    event counts as a contact.
    """

    id: str
    selects: str
    phone_rule: str
    weekday: int | None = None
    file_part: str = ""
    contact_days: int | None = None
    human_only: bool = True

    @property
    def is_core(self) -> bool:
        return self.phone_rule == "core"


# Ids, weekdays (Monday is 0) and file name parts.
BROKEN = Campaign("seg_quebras_rcs", "broken", "strict", 0, "QuebrasRejeitadas")
RIGHT_PERSON = Campaign("ter_cpc", "right_person", "strict", 1, "CPC")
NOT_CONTACTED = Campaign("qua_nunca_contatados", "not_contacted", "strict", 2, "NuncaContatados")
WHOLE_BASE = Campaign("geral", "all", "loose", 3, "Geral")
RECENT_BASE = Campaign("base_recente", "recent", "loose", 4, "BaseRecente")
WEEK = (BROKEN, RIGHT_PERSON, NOT_CONTACTED, WHOLE_BASE, RECENT_BASE)

# The older form of the first three lists.
CORE_BROKEN = Campaign("core_quebras", "broken", "core")
CORE_RIGHT_PERSON = Campaign("core_cpc", "right_person", "core")
CORE_NOT_CONTACTED = Campaign(
    "core_nunca", "not_contacted", "core", contact_days=60, human_only=False
)
CORE = (CORE_BROKEN, CORE_RIGHT_PERSON, CORE_NOT_CONTACTED)

# Portfolio code, name and file prefix. The first prefix also serves
# unlisted codes.
PORTFOLIOS = (
    (517, "Itapeva Autos", "AutosPF"),
    (518, "DivZero", "DivZeroPF"),
    (519, "Cedidas", "CedidasPF"),
)


def campaign_dim(spark: SparkSession) -> DataFrame:
    """The week's campaigns, one row each."""
    fields = ["id", "weekday", "file_part"]
    rows = [F.struct(*[F.lit(getattr(c, f)).alias(f) for f in fields]) for c in WEEK]
    return spark.range(1).select(F.inline(F.array(*rows))).withColumnRenamed("id", "campaign")


def campaign_calendar(dates: DataFrame) -> DataFrame:
    """The campaign due on each ``date``; none on weekends. Joins the five campaigns of the week."""
    due = campaign_dim(dates.sparkSession).select("weekday", "campaign")
    with_day = dates.select("date", F.weekday("date").alias("weekday"))
    return with_day.join(F.broadcast(due), "weekday", "left").select("date", "weekday", "campaign")
