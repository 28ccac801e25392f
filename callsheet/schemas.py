"""Schemas of the eight input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The contract key. One run may hold several portfolios, so the contract number
#: alone does not identify a contract.
CONTRACT = ["cod_cli", "nmcont"]

_MONEY = T.DecimalType(12, 2)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    # accounts
    "cadastros_tb": _table(
        cod_cad=T.LongType(),
        nmcont=T.StringType(),
        cod_cli=T.IntegerType(),
        nomecli=T.StringType(),
        cpfcnpj=T.StringType(),
        nascto=T.DateType(),
        infoad=T.StringType(),
        stcli=T.StringType(),
        data_cad=T.DateType(),
        data_arq=T.DateType(),
    ),
    # phones
    "fones_tb": _table(
        cod_cad=T.LongType(),
        dddfone=T.StringType(),
        telefone=T.StringType(),
        status=T.IntegerType(),
        obs=T.StringType(),
    ),
    # contact events; cod_cli holds the account id here
    "hist_tb": _table(
        cod_cli=T.LongType(),
        data_at=T.TimestampNTZType(),
        ocorr=T.StringType(),
        cod_usu=T.StringType(),
    ),
    # event codes
    "stcob_tb": _table(st=T.StringType(), bsc=T.StringType()),
    # agreements
    "acordos_tb": _table(
        cod_aco=T.LongType(),
        nmcont=T.StringType(),
        cod_cli=T.IntegerType(),
        data_aco=T.DateType(),
        data_cad=T.DateType(),
        vlr_aco=_MONEY,
        qtd_p_aco=T.IntegerType(),
        staco=T.StringType(),
    ),
    # contract complements
    "rec_comp_tb": _table(
        nmcont=T.StringType(),
        cod_cli=T.IntegerType(),
        int_1=T.IntegerType(),
        int_2=T.LongType(),
        char_5=T.StringType(),
    ),
    # receivables
    "receber_tb": _table(
        nmcont=T.StringType(),
        cod_cli=T.IntegerType(),
        fat_parc=T.StringType(),
        vlrparc=_MONEY,
    ),
    # collateral
    "bens_tb": _table(
        nmcont=T.StringType(),
        cod_cli=T.IntegerType(),
        chassi=T.StringType(),
        marca=T.StringType(),
        modelo=T.StringType(),
        placa=T.StringType(),
        cor=T.StringType(),
        anofab=T.IntegerType(),
        anomodelo=T.IntegerType(),
    ),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Bring ``df`` to the column order and types of ``table``.

    Columns of the right type stay bare, so that filters on them reach any source.
    """
    return df.select(
        *[
            F.col(f.name)
            if df.schema[f.name].dataType == f.dataType
            else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[table]
        ]
    )
