"""Record to table: cleaner registry, skip rule, projection.

A cleaner maps a DataFrame to a DataFrame. Its input has one text column per raw field of the source,
``filled`` (see ``parse_records``) and the place columns. Dropping a row filters it, keeping it maps it, and
exploding an array makes several rows of it. Cleaners never see each other's changes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.catalog import DEFAULT_CATALOG, Catalog
from threadloom.functions import scalars as S
from threadloom.operators.keys import drop_listed
from threadloom.session import bounded_broadcast
from threadloom.sources.ndjson import count_filled

Cleaner = Callable[[DataFrame], DataFrame]

BAD_RULES = "bad_rules"
BAD_DATE = "bad_date"

RULE_FIELDS = ("rule_id", "priority", "short_name", "description", "kind", "created_utc", "violation_reason")


def keep(records: DataFrame) -> DataFrame:
    return records


def clean_edited(records: DataFrame) -> DataFrame:
    """``edited`` is false or the time of the edit in the dumps; it becomes a yes/no flag."""
    return records.withColumn("edited", S.to_flag(F.col("edited")).cast("string"))


def clean_distinguished(records: DataFrame) -> DataFrame:
    return records.filter(F.col("distinguished").isNotNull())


def clean_removed(records: DataFrame) -> DataFrame:
    return records.filter(F.col("removal_reason").isNotNull() | F.col("removed_by").isNotNull())


def author_cleaner(ignored: DataFrame | None) -> Cleaner:
    """Drop accounts on the ignore list (column ``name``, normalised)."""
    if ignored is None:
        return keep
    names = bounded_broadcast(ignored)

    def clean(records: DataFrame) -> DataFrame:
        return drop_listed(records, S.normal_name(F.col("author")), names)

    return clean


def clean_rules(records: DataFrame) -> DataFrame:
    """One row per rule with a key computed from the community and the rule.

    For the skip rule only the rule's own values and its community count, not the rest of the line.
    """
    rule = "array<struct<" + ", ".join(f"`{f}` string" for f in RULE_FIELDS) + ">>"
    place = [c for c in records.columns if c not in (*RULE_FIELDS, "rules", "subreddit", "filled")]
    unpacked = records.select(
        *place, "subreddit", F.explode(F.from_json("rules", rule)).alias("_rule")
    ).filter(F.col("_rule").isNotNull())
    key = S.rule_key(
        F.col("subreddit"), F.col("_rule.priority"), F.col("_rule.short_name"), F.col("_rule.description")
    )
    rows = unpacked.select(
        *place,
        "subreddit",
        F.coalesce(F.col("_rule.rule_id"), key).alias("rule_id"),
        *[F.col(f"_rule.{f}").alias(f) for f in RULE_FIELDS if f != "rule_id"],
    )
    return rows.withColumn("filled", count_filled([F.col(c) for c in ("subreddit", *RULE_FIELDS)]))


def rules_faults(records: DataFrame) -> DataFrame:
    """Records whose ``rules`` are there but are no list of objects."""
    text = F.trim(F.col("rules"))
    parsed = F.from_json("rules", "array<struct<" + ", ".join(f"`{f}` string" for f in RULE_FIELDS) + ">>")
    unread = parsed.isNull() | F.exists(parsed, lambda rule: rule.isNull())
    return records.filter((text != "") & unread).withColumn("fault", F.lit(BAD_RULES))


def wiki_date(records: DataFrame) -> Column:
    return S.epoch_seconds(F.col("revision_date"))


def wiki_faults(records: DataFrame) -> DataFrame:
    """Wiki records whose revision date cannot be read."""
    return records.filter(wiki_date(records).isNull()).withColumn("fault", F.lit(BAD_DATE))


def wiki_cleaner(pattern: str = S.WIKI_PATH_PATTERN, content_length: int | None = None) -> Cleaner:
    """Date to epoch seconds, community name out of the path, and the text, whole or cut to ``content_length``.

    Rows without a community in the path are dropped; rows with an unreadable date go to quarantine.
    """

    def clean(records: DataFrame) -> DataFrame:
        return (
            records.withColumn("revision_date", wiki_date(records).cast("string"))
            .withColumn("subreddit", S.wiki_community(F.col("path"), pattern))
            .withColumn("content", S.cut(F.col("content"), content_length))
            .filter(F.col("revision_date").isNotNull() & (F.col("subreddit") != ""))
        )

    return clean


class CleanerRegistry:
    """Cleaner per table; a table without one is passed through.

    A table may also have a finder of faulty records, which gives the records its cleaner drops as unreadable, with the reason in ``fault``.
    """

    def __init__(self, cleaners: Mapping[str, Cleaner] | None = None, faults: Mapping[str, Cleaner] | None = None):
        self._cleaners, self._faults = dict(cleaners or {}), dict(faults or {})

    def register(self, table: str, cleaner: Cleaner, faults: Cleaner | None = None) -> None:
        self._cleaners[table] = cleaner
        if faults is not None:
            self._faults[table] = faults

    def get(self, table: str) -> Cleaner:
        return self._cleaners.get(table, keep)

    def faults(self, table: str) -> Cleaner | None:
        return self._faults.get(table)


def default_cleaners(ignored: DataFrame | None = None) -> CleanerRegistry:
    """Built-in cleaners. Tables not named here keep every record."""
    return CleanerRegistry(
        {
            "post": clean_edited,
            "comment": clean_edited,
            "author": author_cleaner(ignored),
            "distinguished_post": clean_distinguished,
            "removed": clean_removed,
            "subreddit_rules": clean_rules,
            "wiki": wiki_cleaner(),
        },
        {"subreddit_rules": rules_faults, "wiki": wiki_faults},
    )


def left_out(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that the skip rule drops."""
    return rows.filter(~F.coalesce(~key_fault(keys) & (F.col("filled") > len(keys)), F.lit(False)))


def key_fault(keys: Sequence[str]) -> Column:
    """True where any key value is NULL or empty."""
    fault = F.lit(False)
    for key in keys:
        fault = fault | F.col(key).isNull() | (F.col(key) == "")
    return fault


def apply_skip_rule(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL or empty key, and rows where every other value is NULL or empty.

    The second test counts the values of the raw record (``filled``), so a value outside the table
    counts too. With all keys filled, more filled values than keys means some other value is there.
    """
    return rows.filter(~key_fault(keys) & (F.col("filled") > len(keys)))


def project(rows: DataFrame, table: str, catalog: Catalog = DEFAULT_CATALOG, extra: Sequence[str | Column] = ()) -> DataFrame:
    """The table's columns in their declared types; a field the record lacks is NULL."""
    present = set(rows.columns)

    def column(field) -> Column:
        kind = field.dataType.simpleString()
        sql = S.coercion_sql(field.name, kind) if field.name in present else f"CAST(NULL AS {kind})"
        return F.expr(sql).alias(field.name)

    return rows.select(*[column(f) for f in catalog.schema(table).fields], *extra)


def _lost_names(rows: DataFrame, table: str, catalog: Catalog) -> list[Column]:
    """For each typed column its name where the row has a value there that the type cannot hold."""
    present = set(rows.columns)
    typed = {f.name: f.dataType.simpleString() for f in catalog.schema(table).fields if f.name in present}
    return [
        F.expr(f"CASE WHEN `{n}` IS NOT NULL AND {S.coercion_sql(n, k)} IS NULL THEN '{n}' END")
        for n, k in typed.items()
        if k != "string"
    ]


def loses_values(rows: DataFrame, table: str, catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """Whether a row has a value its declared type cannot hold."""
    names = _lost_names(rows, table, catalog)
    return F.coalesce(*names).isNotNull() if names else F.lit(False)


def lost_values(rows: DataFrame, table: str, catalog: Catalog = DEFAULT_CATALOG) -> DataFrame:
    """Rows with a value its declared type cannot hold, with the column names in ``fault``.

    Such a value is stored as NULL, and the row is reported here instead of being changed in silence.
    """
    names = _lost_names(rows, table, catalog)
    if not names:
        return rows.limit(0).withColumn("fault", F.lit(""))
    joined = F.concat_ws(",", *names)
    return rows.filter(joined != "").withColumn("fault", F.concat(F.lit("bad_value:"), joined))


def clean_table(
    records: DataFrame, table: str, registry: CleanerRegistry, catalog: Catalog = DEFAULT_CATALOG
) -> DataFrame:
    """Cleaned and kept records of one table, before projection."""
    return apply_skip_rule(records.transform(registry.get(table)), catalog.key(table))


def normalise(
    records: DataFrame,
    source: str,
    registry: CleanerRegistry,
    catalog: Catalog = DEFAULT_CATALOG,
    extra: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """One parsed DataFrame fanned out to a lazily built DataFrame per table of the source."""
    return {
        table: project(clean_table(records, table, registry, catalog), table, catalog, extra)
        for table in catalog.sources[source].tables
    }
