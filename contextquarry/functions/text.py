"""Text functions as columns: identifier tokens, rendered tiers, token estimates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an identifier's parts meet, at underscores and changes of case or to and from digits.
BOUNDARY = "_|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])"
#: Whether a word has such a place: most words of a text have none, and aren't cut.
BOUNDED = "_|[a-z][A-Z0-9]|[0-9][a-z]|[A-Z][A-Z][a-z]"
TIERS = ("full", "skeleton", "signature")


def tokenize(text: str) -> list[str]:
    """Identifier tokens of a string that is at hand, such as a task; tokens() does the same for columns."""
    out = []
    for word in re.findall(r"[A-Za-z0-9_]+", text):
        whole = word.lower()
        out += [whole, *(p for p in map(str.lower, re.split(BOUNDARY, word)) if p and p != whole)]
    return out


def tokens(text: Column) -> Column:
    """Each identifier in small letters, followed by its parts unless a part is the whole. Null has no tokens."""

    def parts(word: Column) -> Column:
        whole = F.lower(word)
        own = F.filter(F.transform(F.split(word, BOUNDARY), F.lower), lambda p: (p != "") & (p != F.lower(word)))
        return F.when(word.rlike(BOUNDED), F.concat(F.array(whole), own)).otherwise(F.array(whole))

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), parts))


def render(tier: str, signature: Column, doc_first: Column, doc_rest: Column, body: Column) -> Column:
    """A symbol's text at a tier: its parts that aren't empty, a line each, and a blank line."""
    shown = {"signature": [signature], "skeleton": [signature, doc_first], "full": [signature, doc_first, doc_rest, body]}[tier]
    return F.concat(F.array_join(F.filter(F.array(*shown), lambda p: p != ""), "\n"), F.lit("\n\n"))


def estimate(text: Column) -> Column:
    """Tokens of a text, estimated: a quarter of its characters, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4).cast("long"))


def with_costs(symbols):
    """Add the struct tokens (signature, skeleton, full) of estimates for the rendered tiers."""
    cost = lambda tier: estimate(render(tier, *map(F.col, ("signature", "doc_first", "doc_rest", "body")))).alias(tier)
    return symbols.withColumn("tokens", F.struct(cost("signature"), cost("skeleton"), cost("full")))


def split_doc(text: Column) -> tuple[Column, Column]:
    """The first line that isn't blank, and the lines after it."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x) != ""), F.lit(True))
    rest = F.slice(lines, (at + 1).cast("int"), F.greatest(F.size(lines) - at.cast("int"), F.lit(0)))
    return F.when(at > 0, F.element_at(lines, at.cast("int"))).otherwise(""), F.when(at > 0, F.array_join(rest, "\n")).otherwise("")


# DuckDB twins of the above


def tokens_sql(text: str) -> str:
    cut = "w"
    for a in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([a-z])([0-9])", "([0-9])([a-z])"):
        cut = f"regexp_replace({cut}, '{a}', '\\1_\\2', 'g')"
    return (
        f"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9_]+'), lambda w: list_concat([lower(w)], "
        f"list_filter(string_split(lower({cut}), '_'), lambda p: p <> '' AND p <> lower(w)))))"
    )


def render_sql(tier: str) -> str:
    shown = {"signature": "signature", "skeleton": "signature, doc_first", "full": "signature, doc_first, doc_rest, body"}[tier]
    return f"array_to_string(list_filter([{shown}], lambda p: p <> ''), chr(10)) || chr(10) || chr(10)"


def estimate_sql(text: str) -> str:
    return f"greatest(1, length({text}) // 4)"
