"""JSON objects out of free model text.

The cut needs a left-to-right scan and the verdict needs a strict parser, which
Spark's own JSON functions are not (they accept trailing text and refuse NaN).
Texts without an opening brace are settled by Spark; only the rest goes through
one Arrow-batched function.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

RESULT = "valid boolean, json string"
#: Bytes of texts that are Python objects at a time; a longer text is alone.
SLICE = 1 << 20
# Fixed value: a fenced JSON block.
FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)
GREEDY = re.compile(r"\{.*\}", re.S)


def _first_object(text: str, skip_strings: bool) -> str | None:
    """The text from the first brace to the one that closes it, or None."""
    start = text.find("{")
    if start < 0:
        return None
    # With strings in mind an escaped character is one step and counts for nothing.
    token = re.compile(r'\\.|["{}]', re.S) if skip_strings else re.compile(r"[{}]")
    depth, quoted = 0, False
    for found in token.finditer(text, start):
        mark = found.group()
        if mark == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif mark == "{":
            depth += 1
        elif mark == "}":
            depth -= 1
            if depth == 0:
                return text[start:found.end()]
    return None


def _greedy(text: str) -> str | None:
    found = GREEDY.search(text)
    return found.group() if found else None


def _candidates(text: str, policy: str) -> list:
    """Texts to parse, in order; the first that parses wins."""
    if policy == "service":
        fence = FENCED.search(text)
        if fence:
            return [fence.group(1)]
        return [_first_object(text, skip_strings=True), _greedy(text)]
    if policy == "eval":
        parts = [p for p in text.split("```") if "{" in p] if "```" in text else []
        return [_first_object(max(parts, key=len) if parts else text, skip_strings=False)]
    if policy == "greedy":
        return [text, _greedy(text)]
    if policy == "judge":
        return [_greedy(text)]
    raise ValueError(f"unknown policy {policy!r}")


def recover_text(text: str | None, policy: str) -> tuple:
    """(valid, JSON text) of one model output."""
    if text is None:
        return False, None
    for candidate in _candidates(text, policy):
        if candidate is None:
            continue
        try:
            value = json.loads(candidate)
        except (ValueError, RecursionError):
            continue
        # Spark's parser refuses NaN and repeated keys; write what the strict parser understood.
        return True, json.dumps(_finite(value), ensure_ascii=False)
    return False, None


def _finite(value):
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in slices of about ``SLICE`` bytes."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + n > SLICE:
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += n
    yield texts.slice(start)


def recover_texts(batches: Iterator[pa.Array], policy: str) -> Iterator[pa.Array]:
    """``recover_text`` of every text, a slice at a time: beside the batch that came only a slice is held."""
    for texts in batches:
        for part in _slices(texts):
            found = [recover_text(t, policy) for t in part.to_pylist()]
            valid, read = pa.array([v for v, _ in found], pa.bool_()), pa.array([t for _, t in found], pa.string())
            yield pa.StructArray.from_arrays([valid, read], ["valid", "json"])


def recover_json(c: Column, policy: str = "service") -> Column:
    """struct(valid, json) of a model text under one of four policies.

    ``service``: fenced block, else first balanced object (braces in strings
    ignored), else first-to-last brace. ``eval``: longest fenced part, braces in
    strings count. ``greedy``: the whole text, else first-to-last brace.
    ``judge``: first-to-last brace only.
    """

    @arrow_udf(RESULT)
    def recover(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from recover_texts(batches, policy)

    settled = F.struct(F.lit(False).alias("valid"), F.lit(None).cast("string").alias("json"))
    # The greedy policy also takes texts that are JSON without being an object.
    possible = c.isNotNull() if policy == "greedy" else F.contains(c, F.lit("{"))
    # A null input is cheap in the function, so the text is only sent where it may hold an object.
    sent = recover(F.when(possible, c))
    return F.when(F.coalesce(possible, F.lit(False)), sent).otherwise(settled)


def json_text(variant: Column, path: str) -> Column:
    """A text field of a recovered object; null where it is absent."""
    return F.try_variant_get(variant, path, "string")


def error_recipe(text: Column) -> Column:
    """Name and steps of the record that stands in for an unreadable recipe."""
    return F.struct(
        F.lit("error").alias("status"),
        F.lit("Error").alias("name"),
        F.lit("Unknown").alias("cuisine"),
        F.lit("Unknown").alias("culinary_preference"),
        F.lit("N/A").alias("time"),
        F.concat(F.lit("Failed to parse recipe. Raw output:\n"), text).alias("steps"),
        F.lit("Please try again").alias("note"),
    )
