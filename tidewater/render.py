"""Rows as plain text."""

from __future__ import annotations

from collections.abc import Sequence

#: Letters of a value that are shown, and of a line of it.
MOST_LETTERS, MOST_WIDTH = 75, 48


def shown(value: object) -> list[str]:
    """A value's lines: cut with dots after 75 letters, wrapped at 48."""
    text = "null" if value is None else str(value).replace("\n", " ")
    text = text if len(text) <= MOST_LETTERS else text[:MOST_LETTERS] + "..."
    return [text[k : k + MOST_WIDTH] for k in range(0, len(text), MOST_WIDTH)] or [""]


def table(names: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    cells = [[shown(v) for v in row] for row in [names, *rows]]
    widths = [max(len(line) for row in cells for line in row[k]) for k in range(len(names))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    out = [rule]
    for k, row in enumerate(cells):
        for line in range(max((len(c) for c in row), default=1)):
            out.append("|" + "|".join(f" {c[line] if line < len(c) else '':<{w}} " for c, w in zip(row, widths, strict=True)) + "|")
        if k == 0 or k == len(cells) - 1:
            out.append(rule)
    return "\n".join(out)
