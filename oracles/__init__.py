"""DuckDB statements that give the expected result of each registered query."""

from __future__ import annotations

import re

from oracles.views import VIEWS


def with_views(sql: str) -> str:
    """Put the derived fleet views that a statement names in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    own = re.match(r"\s*WITH\s+", sql, re.IGNORECASE)
    return f"WITH {ctes},\n{sql[own.end():].strip()}" if own else f"WITH {ctes}\n{sql.strip()}"


def statements() -> dict[str, str]:
    from oracles import catalog, changes, documents, fleet, settings, storage

    found: dict[str, str] = {}
    for module in (catalog, changes, documents, fleet, settings, storage):
        found.update(module.ORACLES)
    return found
