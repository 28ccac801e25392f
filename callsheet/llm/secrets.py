"""Secret scans by ownership frequency over the whole corpus, in DataFrame functions only.

Base patterns find candidate secrets in every text, and so does a broader pattern for
random-looking strings. Candidates' values are hashed and aggregated over the corpus: a
value that many repositories or owners hold is an example that people copy, one that
few of them hold and that looks random is taken for a live credential. The broader
candidates become findings only if they are live by that measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm.common import stored

#: Patterns by kind, in the order in which spans at the same place are listed, the group
#: that holds the secret and the code points it must have. Only `assign` may find less: a
#: match that is too short there still takes its place in the text.
KINDS = (
    ("assign",
     r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
     2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("random", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
BASE = ("assign", "access", "hex")
#: A text without a match of this has no candidate of the kind; cheaper than the pattern.
HINTS = {
    "assign": r"(?i:passw|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "random": r"[A-Za-z0-9+/_=-]{20}",
}
#: A live value is held by at most so many owners and repositories ...
MAX_OWNERS = 2
MAX_REPOSITORIES = 3
#: ... has at least so many different characters, and contains none of these (fixed) words.
LEAST_DISTINCT = 8
DUMMY = r"(?i)example|sample|dummy|changeme|placeholder|test|xxxx|your|1234567"
#: Random-looking values have all of these.
MIXED = ("[0-9]", "[a-z]", "[A-Z]")


def candidates(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The leftmost disjoint matches and the lengths of the pieces before, between and after.

    A match is its `size`, the `value_hash` (NULL if the value is shorter than `least`)
    and `plausible`, whether the value looks live: no text of it goes any further.
    """
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = F.transform(
        matches,
        lambda m: F.struct(
            F.length(m).alias("size"), F.regexp_extract(m, f"^(?:{pattern})$", group).alias("value")
        ),
    )
    found = F.transform(
        values,
        lambda v: F.struct(
            v["size"].alias("size"),
            F.when(F.length(v["value"]) >= least, F.sha2(v["value"], 256)).alias("value_hash"),
            looks_live(v["value"], kind).alias("plausible"),
        ),
    )
    return F.when(
        text.rlike(HINTS[kind]),
        F.struct(
            found.alias("found"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps")
        ),
    )


def looks_live(value: Column, kind: str) -> Column:
    """Whether a value is no dummy and varied; one of the broader kind also has to be mixed."""
    test = ~value.rlike(DUMMY) & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT)
    for pattern in MIXED if kind not in BASE else ():
        test = test & value.rlike(pattern)
    return test


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    repository_column: str = "source",
    owner_column: str | None = None,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """`id` and `findings` of every row.

    `findings` is an array, by start and then kind as in KINDS, of `kind`, `start`, `end`
    (code points, end exclusive), `value_hash` (SHA-256), `owners`, `repositories` (how
    many hold the value) and `live`. All matches of the base kinds are in it, and live
    matches of the broader kind that overlap no base match.

    An owner is the part of the repository before the first slash unless a column names
    it. Null texts are empty; a null repository or owner counts as one of its own. Every
    input row gives a row, equal ones too.
    """
    repository = F.coalesce(F.col(repository_column).cast("string"), F.lit(""))
    owner = (
        F.substring_index(repository, "/", 1)
        if owner_column is None
        else F.coalesce(F.col(owner_column).cast("string"), F.lit(""))
    )
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    # One pass over the texts; what is kept of them is narrow and gives rows a number.
    rows = docs.select(
        F.col(id_column).alias("id"), repository.alias("repository"), owner.alias("owner"), text.alias("text")
    ).select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "repository",
        "owner",
        *[candidates(F.col("text"), *kind).alias(kind[0]) for kind in KINDS],
    )
    rows = stored(rows)
    with_any = rows.where(" OR ".join(f"{kind[0]} IS NOT NULL" for kind in KINDS))
    spans = None
    for order, (kind, *_) in enumerate(KINDS):
        part = _places(with_any.where(F.col(kind).isNotNull()), kind)
        part = part.select(
            "row", "repository", "owner", F.lit(order).alias("order"), F.lit(kind).alias("kind"),
            "start", "end", "match.value_hash", "match.plausible",
        ).where(F.col("value_hash").isNotNull())
        spans = part if spans is None else spans.unionByName(part)
    spans = stored(spans)
    judged = (
        # Stored, so that the join can split a value that very many rows hold.
        spans.join(stored(ownership(spans)), "value_hash")
        .withColumn(
            "live",
            F.col("plausible")
            & (F.col("owners") <= max_owners)
            & (F.col("repositories") <= max_repositories),
        )
        .where(F.col("kind").isin(*BASE) | F.col("live"))
    )
    # A broader match inside or across a base match adds nothing.
    by_row = Window.partitionBy("row").orderBy("start", "order")
    earlier = by_row.rowsBetween(Window.unboundedPreceding, -1)
    later = by_row.rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind") != "random"
    added = judged.select(
        "*",
        F.max(F.when(base, F.col("end"))).over(earlier).alias("base_end"),
        F.min(F.when(base, F.col("start"))).over(later).alias("base_start"),
    ).where(
        base
        | (
            (F.coalesce("base_end", F.lit(0)) <= F.col("start"))
            & (F.coalesce(F.col("base_start"), F.col("end")) >= F.col("end"))
        )
    )
    finding = F.struct(
        "start", "order", "end", "kind", "value_hash", "owners", "repositories", "live"
    )
    found = added.groupBy("row").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    none = F.expr("array()").cast(found.schema["findings"].dataType)
    return (
        rows.select("row", "id")
        .join(found, "row", "left")
        .select("id", F.coalesce("findings", none).alias("findings"))
    )


def ownership(spans: DataFrame) -> DataFrame:
    """How many distinct owners and repositories (of an owner) hold each value.

    Needs `value_hash`, `owner`, `repository`. Copies fall away on the map side first,
    so a value that a third of the rows hold costs a row per task and repository.
    """
    held = spans.select("value_hash", "owner", "repository").distinct()
    by_owner = held.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(
        F.count("*").alias("owners"), F.sum("n").alias("repositories")
    )


def _places(rows: DataFrame, kind: str) -> DataFrame:
    """One row per match with its start and end, from matches and gaps."""
    found = rows.select(
        "row", "repository", "owner", F.col(f"{kind}.gaps").alias("gaps"),
        F.posexplode(f"{kind}.found").alias("place", "match"),
    )
    upto = Window.partitionBy("row").orderBy("place")
    return found.select(
        "row", "repository", "owner", "match", F.get("gaps", F.col("place")).alias("gap"), "place"
    ).select(
        "row", "repository", "owner", "match",
        F.sum(F.col("gap") + F.col("match.size")).over(upto).alias("end"),
    ).withColumn("start", F.col("end") - F.col("match.size"))


def joined(findings: Column) -> Column:
    """The findings as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ","
    )
