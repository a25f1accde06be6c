"""Integrity rules of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (child table, column, parent table, parent column).
FOREIGN_KEYS = (
    ("sessions", "user_id", "users", "user_id"),
    ("sessions_all", "user_id", "users", "user_id"),
    ("queries", "user_id", "users", "user_id"),
    ("queries", "session_id", "sessions", "session_id"),
    ("queries", "session_id_all", "sessions_all", "session_id"),
    ("stages", "query_id", "queries", "query_id"),
)
NOT_NULL = (("queries", "text"),)


def fk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """``(rule, value, n_rows)`` for every key value without a parent and every forbidden null.

    Each table is read once. A row gives its own key, as a parent, and its references, as children of the rules they fall under;
    one aggregation with map-side combine then brings together a key's parents and children. A frequent value is one row a
    task there. Rules whose tables or columns are absent do not apply.
    """
    rules = [
        (n, child, column, parent, parent_column)
        for n, (child, column, parent, parent_column) in enumerate(FOREIGN_KEYS)
        if child in tables and parent in tables and column in tables[child].columns
    ]
    nulls = [(len(FOREIGN_KEYS) + n, table, column) for n, (table, column) in enumerate(NOT_NULL) if table in tables]

    def tag(domain: str, value: Column, rule: int | None) -> Column:
        """A key of a domain: a parent without a rule, or a child under one."""
        fields = F.lit(domain).alias("domain"), value.cast("string").alias("value"), F.lit(rule).cast("int").alias("rule")
        return F.struct(*fields)

    tagged = []
    for name, table in tables.items():
        domains = {(parent, parent_column) for _, _, _, parent, parent_column in rules if parent == name}
        tags = [tag(f"{parent}.{column}", F.col(column), None) for parent, column in sorted(domains)]
        tags += [tag(f"{p}.{pc}", F.col(column), n) for n, child, column, p, pc in rules if child == name]
        tags = [F.when(t["value"].isNotNull(), t) for t in tags]
        tags += [F.when(F.col(column).isNull(), tag("", F.lit(None), n)) for n, of, column in nulls if of == name]
        if tags:
            tagged.append(table.select(F.inline(F.array_compact(F.array(*tags)))))
    if not tagged:
        raise ValueError("no rule applies to these tables")
    texts = {n: f"{child}.{column} in {parent}.{parent_column}" for n, child, column, parent, parent_column in rules}
    texts |= {n: f"{table}.{column} not null" for n, table, column in nulls}
    # Most children share a value with a parent: rows are counted before they are told apart by rule.
    counts = [F.count_if(F.col("rule") == n).alias(f"r{n}") for n in texts]
    keys = reduce(DataFrame.unionByName, tagged).groupBy("domain", "value").agg(F.count_if(F.col("rule").isNull()).alias("parents"), *counts)
    found = [F.struct(F.lit(text).alias("rule"), F.col(f"r{n}").alias("n_rows")) for n, text in texts.items()]
    orphans = keys.filter(F.col("parents") == 0).select("value", F.inline(F.array(*found)))
    return orphans.filter(F.col("n_rows") > 0).select("rule", "value", "n_rows")
