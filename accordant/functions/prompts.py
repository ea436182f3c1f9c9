"""Prompt rendering: a template is filled once per run, the text per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from accordant.functions.text import _col

# Slots a template may use: {text}, {categories}, {description}, {description_lower}, {examples}.
TEMPLATES = {
    "base": (
        "Act as a careful annotator of text categories.\n\n"
        "Categories:\n{categories}\n\n"
        "{description} to classify:\n{text}\n\n"
        "Answer with the number of the best category for this {description_lower} and nothing else."),
    "few_shot": (
        "Labelled examples:\n\n{examples}\n\n"
        "Categories:\n{categories}\n\n"
        "{description} to classify:\n{text}\n\n"
        "Answer with the number of the best category for this {description_lower} and nothing else."),
    "reasoned": (
        "Categories:\n{categories}\n\n"
        "{description} to classify:\n{text}\n\n"
        "Weigh topic, tone and the signs of each category for this {description_lower}. "
        "End with a line that reads CLASSIFICATION: followed by the category number."),
    "simple": (
        "{description}: {text}\nWhich category number fits this {description_lower}?\n{categories}"),
}


def category_block(meanings: Mapping[str, str]) -> str:
    """``- key: meaning`` lines for a template."""
    return "\n".join(f"- {key}: {value}" for key, value in meanings.items())


def category_block_column(meanings: Column) -> Column:
    """The same lines from a map column."""
    return F.array_join(
        F.transform(F.map_entries(meanings),
                    lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")


def numbered(labels: Sequence[object]) -> dict[str, str]:
    """Meanings for a plain category list: position to label."""
    return {str(i): str(label) for i, label in enumerate(labels)}


def example_block(examples: DataFrame, order: str, shots: int = 8) -> DataFrame:
    """One row with the first ``shots`` few-shot examples in the given order.

    The block goes into every prompt, so its size is a parameter, not that of the labelled table.
    """
    shown = F.concat(F.lit("Text: "), F.col("text"), F.lit("\nCategory: "), F.col("category").cast("string"))
    rows = examples.orderBy(order).limit(shots).select(F.struct(F.col(order).alias("o"), shown.alias("s")).alias("e"))
    return rows.agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("e")), lambda e: e["s"]), "\n\n").alias("examples"))


def render(template: str, text: Column | str, *, meanings: Mapping[str, str],
           description: str = "Text", examples: Column | None = None) -> Column:
    """The prompt for each row.  ``template`` is a known name or any template string."""
    body = TEMPLATES.get(template, template)
    slots = {"{categories}": category_block(meanings), "{description}": description,
             "{description_lower}": description.lower()}
    for slot, value in slots.items():
        body = body.replace(slot, value)
    # The remaining slots vary by row: cut the template at them and concatenate, so that
    # braces inside a text are never taken for a slot.
    parts: list[Column] = []
    rest = body
    while rest:
        spots = [(rest.find(s), s) for s in ("{text}", "{examples}") if s in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, slot = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        if slot == "{text}":
            parts.append(_col(text))
        else:
            parts.append(examples if examples is not None else F.lit(""))
        rest = rest[at + len(slot):]
    return F.concat(*parts)
