"""Text templates: named and positional slots, and regex rules with capture groups."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# An escape character and the letters after it stand for an escaped and an inserted percent sign and for the escape
# character itself, so that every text comes back as it was.
_ESCAPE, _PERCENT = "\u0001", "p"


def _protect(text: Column) -> Column:
    return F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _ESCAPE))


def _guard(text: Column) -> Column:
    return F.replace(_protect(text), F.lit("`%"), F.lit(_ESCAPE + _PERCENT))


def _inserted(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.replace(_protect(text), F.lit("%"), F.lit(_ESCAPE + _PERCENT))


def _restore(text: Column) -> Column:
    """Read from left to right, each escape character with what follows it."""
    parts = F.split(text, _ESCAPE + _ESCAPE, -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit(_ESCAPE + _PERCENT), F.lit("%"))), _ESCAPE)


def fill_named(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace ``%{key}``; unknown keys and null values give nothing, a backtick escapes the percent sign.
    A slot that is never closed stays as it is."""
    out = _guard(template)
    known = "|".join(re.escape(key) for key in values)
    out = F.regexp_replace(out, r"%\{(?!(?:" + known + r")\})[^}]*\}", "")
    for key, value in values.items():
        out = F.replace(out, F.lit("%{" + key + "}"), _inserted(value))
    return _restore(out)


def fill_fixed(template: str, values: Mapping[str, Column]) -> Column:
    """``fill_named`` for a template that is known when the plan is made: one concatenation."""
    pieces = []
    for piece in re.split(r"(`%|%\{[^}]*\})", template):
        if piece == "`%":
            pieces.append(F.lit("%"))
        elif re.fullmatch(r"%\{[^}]*\}", piece):
            if piece[2:-1] in values:
                pieces.append(F.coalesce(values[piece[2:-1]].cast("string"), F.lit("")))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def fill_positional(template: Column, values: Sequence[Column]) -> Column:
    """Replace each ``%`` by the next value; none left gives nothing."""
    parts = F.split(_guard(template), "%")
    slots = F.array(*[_inserted(v) for v in values])
    used = F.slice(slots, F.lit(1), F.size(parts) - 1)
    joined = F.zip_with(parts, used, lambda part, slot: F.concat(part, F.coalesce(slot, F.lit(""))))
    return _restore(F.array_join(joined, ""))


def _with_groups(text: Column, pattern: str, template: str, groups: int) -> Column:
    """``template`` with the first ``$&`` and the first ``$n`` of each group filled from the match."""
    pieces: list[Column | str] = [template]
    for group in range(groups + 1):
        target = "$&" if group == 0 else f"${group}"
        for at, piece in enumerate(pieces):
            if isinstance(piece, str) and target in piece:
                head, tail = piece.split(target, 1)
                pieces[at : at + 1] = [head, F.regexp_extract(text, pattern, group), tail]
                break
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def regex_map(text: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    """Apply ordered (pattern, template) rules. The last matching rule gives the whole result."""
    out = default
    for pattern, template in rules:
        filled = _with_groups(text, pattern, template, re.compile(pattern).groups)
        out = F.when(text.rlike(pattern), filled).otherwise(out)
    return out
