"""Prompts (O28), assembled as columns so that requests stay rows of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACT_SYSTEM = "You turn prose into short factual triples. Answer with JSON only."
EXTRACT = (
    "List every fact of the text as a JSON array of objects with the keys subject, predicate and object. "
    "Write names in lower case and the same way each time, put names in place of pronouns, and keep each predicate to three words or fewer.\nText: <<<"
)
ENTITIES_SYSTEM = "You find names that mean the same thing. Answer with JSON only."
ENTITIES = (
    "Group the names below that denote the same thing. Answer with a JSON object whose keys are the name to keep and whose values are arrays of the other names. Leave out names without a partner.\nNames:\n"
)
BETWEEN_SYSTEM = WITHIN_SYSTEM = "You propose plausible relations between known things. Answer with JSON only."
BETWEEN = "Two groups of names have no link. Propose up to three relations from one to the other as a JSON array of objects with the keys subject, predicate (three words at most) and object. Use the names as they are.\n"
WITHIN = "The pairs below belong together but have no direct link. Propose relations for those that are plausible as a JSON array of objects with the keys subject, predicate (three words at most) and object.\n"


def extract(text: Column) -> Column:
    return F.concat(F.lit(EXTRACT), text, F.lit(">>>"))


def entities(names: Column) -> Column:
    return F.concat(F.lit(ENTITIES), F.array_join(F.array_sort(names), "\n"))


def between(first: Column, second: Column, lines: Column) -> Column:
    return F.concat(F.lit(BETWEEN), F.lit("First: "), F.array_join(first, ", "), F.lit("\nSecond: "), F.array_join(second, ", "), F.lit("\nKnown facts:\n"), F.array_join(lines, "\n"))


def within(pairs: Column, lines: Column) -> Column:
    return F.concat(F.lit(WITHIN), F.lit("Pairs:\n"), F.array_join(pairs, "\n"), F.lit("\nKnown facts:\n"), F.array_join(lines, "\n"))
