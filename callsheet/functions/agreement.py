"""Readable forms of agreement codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Agreement status codes and the labels shown in lists.
STATUS_LABELS = {
    "A": "Em Acordo",
    "E": "Exceção Rejeitada",
    "G": "Pago",
    "Q": "Quebrado",
    "P": "Em Promessa",
}
OTHER_STATUS_LABEL = "Sem Dados"
#: Paid or being paid.
SETTLED = ("P", "G", "A")
#: Broken or rejected.
BROKEN = ("Q", "E")


def status_label(code: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, code), F.lit(OTHER_STATUS_LABEL))


def payment_kind(instalments: Column) -> Column:
    return F.when(instalments == 1, "AVISTA").when(instalments > 1, "PARCELADO")
