"""One mailbox's view of a store: what is read through it is its own, in subqueries and joins too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMN = "mailbox_id"


class UnscopedRead(ValueError):
    """A query reads a relation of all mailboxes without saying which one."""


class Mailbox:
    """The tables of a store as one mailbox sees them. ``tables`` maps names to DataFrames; those with a column mailbox_id hold rows of all mailboxes.

    Without a mailbox (None) nothing is seen. ``table`` and ``sql`` read through views that are filtered already, so no query has to
    remember the mailbox, whatever it joins or nests; the filter reaches the scans (a table that is partitioned by mailbox is read for this one alone).
    ``checked`` refuses a query that came by another way.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], mailbox) -> None:
        from .scope import scoped

        self.spark, self.mailbox = spark, mailbox
        self.tables = {name: scoped(df, mailbox, COLUMN) if COLUMN in df.columns else df for name, df in tables.items()}

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """``text`` with the mailbox's tables named in braces, as in ``select * from {message} m where exists (select 1 from {location} ...)``; ``args`` are bound, never pasted in."""
        used = {name: df for name, df in self.tables.items() if f"{{{name}}}" in text}
        return self.checked(self.spark.sql(text, args=args or {}, **used))

    def checked(self, df: DataFrame) -> DataFrame:
        """``df``, if each relation of all mailboxes that it reads is filtered by this mailbox; otherwise UnscopedRead."""
        found = unscoped_relations(df, self.mailbox)
        if found:
            raise UnscopedRead("not filtered by the mailbox: " + ", ".join(sorted(found)))
        return df


def _conjuncts(condition) -> list:
    if condition.nodeName() == "And":
        return [*_conjuncts(condition.left()), *_conjuncts(condition.right())]
    return [condition]


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def unscoped_relations(df: DataFrame, mailbox, column: str = COLUMN) -> set[str]:
    """The relations with a column ``column`` that ``df`` reads, those of subqueries included, for which its optimized plan has no filter ``column = mailbox``.

    The optimizer has turned subqueries into joins by then, has put each filter above the relation that it is about, and has carried
    equalities across joins, so a side that is joined by its mailbox to a filtered side is filtered too. Rows that the query itself holds are no relation.
    """
    found: set[str] = set()

    def bound(condition, attribute) -> bool:
        if condition.nodeName() != "EqualTo":
            return False
        sides = [condition.left(), condition.right()]
        literals = [x for x in sides if x.nodeName() == "Literal"]
        named = [x for x in sides if x.nodeName() == "AttributeReference" and x.exprId().equals(attribute.exprId())]
        return bool(literals and named) and str(literals[0].value()) == str(mailbox)

    def walk(node, conditions: list) -> None:
        name = node.nodeName()
        if name == "Filter":
            conditions = [*conditions, *_conjuncts(node.condition())]
        children = _items(node.children())
        if not children and name != "LocalRelation":
            for attribute in _items(node.output()):
                if attribute.name() == column and not any(bound(c, attribute) for c in conditions):
                    found.add(node.simpleString(8))
        for child in children:
            walk(child, conditions)
        for inner in _items(node.subqueries()):
            walk(inner, [])

    walk(df._jdf.queryExecution().optimizedPlan(), [])
    return found
