"""The eight input tables, derived from the star schema test data.

Rules and cases are those of FIXTURES.md. Every input row is used; a share of 2 % of the
events and of the complements of every 53rd customer go to accounts and contracts
unknown to the base. Each table is a list of SQL expressions over its source.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.schemas import conform


def _contract(key: str) -> list[str]:
    """Contract and portfolio of a customer.

    A third of the customers share contract CT1 of portfolio 518, some others hold a
    contract of the same number in 519, the rest share contracts by two.
    """
    pair = f"({key} - {key} % 2)"
    return [
        f"CASE WHEN {key} % 3 = 1 OR {key} % 25 = 2 THEN 'CT1' ELSE concat('CT', {pair}) END AS nmcont",
        f"CASE WHEN {key} % 3 = 1 THEN 518 WHEN {key} % 25 = 2 THEN 519 ELSE 517 + {pair} % 3 END AS cod_cli",
    ]


ACCOUNTS = [
    "c_custkey AS cod_cad",
    *_contract("c_custkey"),
    "c_name AS nomecli",
    "lpad(string(c_custkey * 7919), 11, '0') AS cpfcnpj",
    "CASE WHEN c_custkey % 37 <> 0 THEN DATE '1950-01-01' + int(c_custkey * 13 % 18000) END AS nascto",
    """CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN ''
        WHEN c_custkey % 19 = 0 THEN "D'AVILA (IV)"
        ELSE concat(c_mktsegment, ' ', c_nationkey % 2) END AS infoad""",
    """CASE WHEN c_custkey % 17 = 0 THEN 'INA' WHEN c_custkey % 23 = 0 THEN NULL
        ELSE 'ATI' END AS stcli""",
    "DATE '2024-02-15' - int(c_custkey % 121) AS data_cad",
    "DATE '2024-02-15' - int(c_custkey % 121) + if(c_custkey % 5 = 0, 3, 0) AS data_arq",
]

# k is the customer, n the phone, c its copy: the first two phones are there twice, with
# other notes.
PHONES = [
    "k AS cod_cad",
    "CASE WHEN (k + n) % 41 <> 0 THEN string(11 + n % 9) END AS dddfone",
    """CASE (k * 7 + n % 9) % 19 WHEN 0 THEN '99999999' WHEN 1 THEN '9x123456'
        WHEN 2 THEN '12345' WHEN 3 THEN '91111123'
        ELSE string(91200000 + (k * 9 + n % 9) * 7919 % 7000000) END AS telefone""",
    "CASE WHEN (k + n * 5) % 13 <> 12 THEN (k * 3 + n * 5) % 8 END AS status",
    """CASE (k + n * 3 + c * 5) % 11 WHEN 0 THEN 'Desconhecido' WHEN 1 THEN 'numero incorreto'
        WHEN 2 THEN NULL WHEN 3 THEN 'Descontinuado' ELSE 'ok' END AS obs""",
]

# One of 50 events belongs to an account outside the base, with a negative id.
EVENTS = [
    """CASE WHEN event_id % 50 = 49 THEN -1 - (user_id * 10 + event_id % 10)
        ELSE user_id * 10 + event_id % 10 END AS cod_cli""",
    "ts - make_dt_interval(int(event_id div 10 % 4 * 45)) AS data_at",
    "event_type AS ocorr",
    """CASE WHEN event_id % 5 = 0 THEN '999' WHEN event_id % 11 = 0 THEN NULL
        ELSE concat('U', event_id % 7) END AS cod_usu""",
]

EVENT_CODES = """
    SELECT * FROM VALUES ('click', 'sistema'), ('purchase', 'CPC'), ('signup', 'CPC - promessa'),
        ('view', CAST(NULL AS STRING)) AS t(st, bsc)"""

AGREEMENTS = [
    "o_orderkey AS cod_aco",
    *_contract("o_custkey"),
    "date(o_orderdate) AS data_aco",
    "date(o_orderdate) AS data_cad",
    "o_totalprice AS vlr_aco",
    "o_orderkey % 4 AS qtd_p_aco",
    # The contract that many share is never settled.
    "substr(if(o_custkey % 3 = 1, 'CEQQECQ', 'AEGQPCQ'), int(o_orderkey % 7 + 1), 1) AS staco",
]

# k is the customer, n the row. Every 53rd customer's rows belong to an unknown contract.
COMPLEMENTS = [
    f"CASE WHEN k % 53 = 0 THEN concat('EX', k) ELSE {_contract('k')[0].removesuffix(' AS nmcont')} END AS nmcont",
    _contract("k")[1],
    "if((k + n) % 4 = 0, 400, 100) AS int_1",
    "k * 10 + n AS int_2",
    "CASE WHEN k % 47 <> 0 THEN concat('PROD', (k + n) % 5) END AS char_5",
]

RECEIVABLES = [
    *_contract("o_custkey"),
    """CASE WHEN l_linenumber = 1 THEN concat('ENTRADA ', l_orderkey)
        WHEN l_linenumber = 2 AND l_orderkey % 10 = 0 THEN 'Entrada parcial'
        ELSE concat('F', l_orderkey % 20, '-', l_linenumber) END AS fat_parc""",
    "l_extendedprice AS vlrparc",
]

GOODS = [
    *_contract("o_custkey"),
    "concat('CH', p_partkey % 500) AS chassi",
    "p_brand AS marca",
    "CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS modelo",
    "CASE WHEN l_orderkey % 97 <> 0 THEN concat('PL', p_partkey % 50) END AS placa",
    "concat(p_type, ' ', l_linenumber) AS cor",
    "1990 + p_size % 30 AS anofab",
    "1991 + p_size % 30 AS anomodelo",
]


class DomainTables(dict):
    """The eight tables by name, each derived when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self._spark = spark
        self._star = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    def __missing__(self, name: str) -> DataFrame:
        self[name] = conform(self._derive(name), name)
        return self[name]

    def _copies(self, last: str) -> DataFrame:
        """Rows 0 to ``last`` for every customer.

        The keys of very many customers fit a file that one task reads, the rows made of
        them do not. So the keys are dealt out first, to a fixed number of tasks, as
        adaptive execution would merge partitions as small as these.
        """
        tasks = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = self._star("customer").select("c_custkey").repartition(tasks, F.xxhash64("c_custkey"))
        return dealt.selectExpr("c_custkey AS k", f"explode(sequence(0, {last})) AS n")

    def _owned(self) -> DataFrame:
        """Line items with the customer of their order."""
        orders = self._star("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey")
        return self._star("lineitem").join(orders, "l_orderkey")

    def _derive(self, name: str) -> DataFrame:
        star = self._star
        match name:
            case "cadastros_tb":
                return star("customer").selectExpr(*ACCOUNTS)
            case "fones_tb":
                numbered = self._copies("11").selectExpr("k", "n % 10 AS n", "n div 10 AS c")
                # Spark works the columns out again at every use in a filter, unless a generator
                # has made them. The method of such a filter is too long for the JVM to compile.
                named = ", ".join(f"'{name}', {value}" for value, name in (e.rsplit(" AS ", 1) for e in PHONES))
                return numbered.selectExpr(f"inline(array(named_struct({named})))")
            case "hist_tb":
                return star("events").selectExpr(*EVENTS)
            case "stcob_tb":
                return self._spark.sql(EVENT_CODES)
            case "acordos_tb":
                return star("orders").selectExpr(*AGREEMENTS)
            case "rec_comp_tb":
                return self._copies("int(c_custkey % 3)").selectExpr(*COMPLEMENTS)
            case "receber_tb":
                return self._owned().selectExpr(*RECEIVABLES)
            case "bens_tb":
                parts = star("part").withColumnRenamed("p_partkey", "l_partkey")
                sold = self._owned().join(parts, "l_partkey").withColumnRenamed("l_partkey", "p_partkey")
                return sold.selectExpr(*GOODS)
        raise KeyError(name)
