"""Many literal phrases against many texts: one pass over a text, whatever the number of phrases."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most entries (500 rules of 100 entries): they may be sent to every task.
MAX_PHRASES = 50_000
#: Up to so many phrases, each is looked for by itself in the JVM.
FEW = 64

PLACES = {"subject": 1, "body": 2, "any": 3}


def phrase_rules(spark: SparkSession, entries: list[tuple[int, str, str]]) -> Column:
    """A column: the rules (sorted, each once) of which a phrase stands in ``subject`` or ``body``, by ``entries`` (rule, place, phrase).

    The phrases are sent to the tasks once, as an automaton over all of them (Aho-Corasick), so a text is read once: time follows its length and the
    phrases that it holds. Containment is literal, in code points, as ``contains`` finds it, within words too. Empty phrases are never met.
    """
    if len(entries) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} phrases")
    by_phrase: dict[str, list[tuple[int, int]]] = {}
    for rule, place, phrase in entries:
        if phrase:
            by_phrase.setdefault(phrase, []).append((rule, PLACES[place or "any"]))
    sent = spark.sparkContext.broadcast(by_phrase)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def met(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for phrase, rules in sent.value.items():
            automaton.add_word(phrase, rules)
        automaton.make_automaton()

        def rules_in(subject: str | None, body: str | None) -> list[int]:
            found: set[int] = set()
            for text, bit in ((subject, 1), (body, 2)):
                if text and sent.value:
                    for rules in {id(r): r for _, r in automaton.iter(text)}.values():
                        found.update(rule for rule, places in rules if places & bit)
            return sorted(found)

        for subjects, bodies in batches:
            yield pd.Series([rules_in(s, b) for s, b in zip(subjects, bodies, strict=True)])

    return met(F.col("subject"), F.col("body"))


def phrase_matches(messages: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, rule) for each rule of which a phrase stands in the message: ``messages`` (id, subject, body), ``phrases`` (rule, place, entry)."""
    rows = phrases.select("rule", "place", "entry").where("entry <> ''").limit(MAX_PHRASES + 1).collect()  # more are refused
    return messages.select("id", F.explode(phrase_rules(messages.sparkSession, [tuple(r) for r in rows])).alias("rule"))
