"""The compact tabular text sink (K1 to K3): `key: value` lines and `name[N]{columns}:` tables with indented rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..operators.context import SECTIONS


def cell(value) -> str:
    """K1: nothing for None, one line, quoted if it holds a comma."""
    if value is None:
        return ""
    text = str(value).replace("\r", "").replace("\n", " ")
    return f'"{text}"' if "," in text else text


class Document:
    """K2."""

    def __init__(self):
        self.lines: list[str] = []

    def pair(self, key: str, value) -> Document:
        self.lines.append(f"{key}: {cell(value)}")
        return self

    def gap(self) -> Document:
        self.lines.append("")
        return self

    def note(self, text: str) -> Document:
        self.lines.append("# " + text)
        return self

    def table(self, name: str, columns: list[str], rows: Iterable) -> Document:
        """A table without rows leaves nothing."""
        rows = list(rows)
        if rows:
            self.lines.append(f"{name}[{len(rows)}]{{{','.join(columns)}}}:")
            self.lines += ["  " + ",".join(map(cell, r)) for r in rows]
        return self

    def frame(self, name: str, df: DataFrame) -> Document:
        return self.table(name, df.columns, map(tuple, df.collect()))

    def text(self) -> str:
        return "\n".join(self.lines).strip()


def context_text(focus: str, sections: DataFrame) -> str:
    """Q13: the sections of a context in their order, from one collected result."""
    out = Document().pair("focus", focus).gap()
    held: dict[str, list] = {}
    for r in sections.orderBy("section", "ord").collect():
        held.setdefault(r["section"], []).append(r["cells"])
    for name, columns in SECTIONS.items():
        if name in held:
            out.table(name, columns[: len(held[name][0])], held[name]).gap()
    return out.text()


def dump_text(rows: DataFrame) -> str:
    columns = {"files": ["path", "language", "subproject"], "symbols": ["id", "name", "type", "file", "line", "signature"]}
    out, held = Document(), {}
    for r in rows.orderBy("section", "ord").collect():
        held.setdefault(r["section"], []).append(r["cells"])
    for name in ("files", "symbols", "imports", "extends", "uses", "calls", "tested_by"):
        out.table(name, columns.get(name, ["from", "to"]), held.get(name, [])).gap()
    return out.text()


def impact_text(target: str, found: DataFrame) -> str:
    rows = found.orderBy("id").collect()
    files, symbols = [(r["id"], r["hops"]) for r in rows if r["ntype"] == "file"], [(r["id"], r["hops"]) for r in rows if r["ntype"] == "symbol"]
    out = Document().pair("impact_target", target).gap()
    if files:
        out.table("affected_files", ["path", "hops"], files)
    else:
        out.pair("affected_files", 0)
    return out.gap().table("affected_symbols", ["symbol", "hops"], symbols).text()


def path_text(source: str, dest: str, found: tuple) -> str:
    nodes, edges = found
    return Document().pair("path_from", source).pair("path_to", dest).gap().table("nodes", ["hop", "id"], enumerate(nodes)).gap().table("edges", ["from", "to", "type", "evidence"], edges).text()


def cycles_text(found: DataFrame, limit: int = 20) -> str:
    """Shortest first; a document also where there are none."""
    rows = [(r["length"], r["chain"]) for r in found.orderBy("length", "chain").collect()]
    out = Document().pair("total_cycles", len(rows)).gap()
    out.table("cycles", ["#", "length", "chain"], [(i, n, " → ".join([*c, c[0]])) for i, (n, c) in enumerate(rows[:limit], 1)])
    if len(rows) > limit:
        out.note(f"{len(rows) - limit} more")
    return out.text()


def communities_text(placed: DataFrame, limit: int = 20) -> str:
    held: dict[int, list[str]] = {}
    for r in placed.orderBy("cid", "path").collect():
        held.setdefault(r["cid"], []).append(r["path"])
    order = sorted(held, key=lambda c: (-len(held[c]), c))
    out = Document().pair("total_communities", len(held)).gap()
    for c in order[:limit]:
        out.table(f"community_{c}", ["path"], [[p] for p in held[c]]).gap()
    if len(order) > limit:
        out.note(f"{len(order) - limit} more communities")
    return out.text()


def search_text(query: str, files: DataFrame | None = None, symbols: DataFrame | None = None, literals: DataFrame | None = None) -> str:
    """Optional columns are shown only if some row has a value."""
    out, some = Document().pair("search", query).gap(), False
    for name, df, columns in (("file_matches", files, ["path", "language", "exports", "imported_by"]), ("symbol_matches", symbols, ["name", "type", "file", "signature", "callers", "intent", "via"]), ("literal_matches", literals, ["value", "symbol", "file", "line"])):
        rows = df.collect() if df is not None else []
        shown = [c for c in columns if c not in ("intent", "via") or any(r[c] for r in rows)]
        out.table(name, shown, [[r[c] for c in shown] for r in rows]).gap()
        some = some or bool(rows)
    return out.text() if some else f"No results for '{query}'."


def diff_text(diff: DataFrame) -> str:
    rows = diff.orderBy("path").collect()
    out = Document()
    out.table("new_files", ["path"], [[r["path"]] for r in rows if r["status"] == "new"]).gap()
    out.table("deleted_files", ["path"], [[r["path"]] for r in rows if r["status"] == "deleted"]).gap()
    out.table("changed_files", ["path", "added", "removed"], [[r["path"], r["added"], r["removed"]] for r in rows if r["status"] == "changed"])
    return out.text()


def header(fresh, response_tokens: int, focus_tokens: int | None = None) -> str:
    """The two lines before an answer."""
    age = f",age_s={int(fresh['age_s'])},stale={str(fresh['stale']).lower()},changed={fresh['files_changed']}" if fresh["indexed"] else ""
    cost = f"cost{{response_tokens={response_tokens}" + (f",focus_tokens={focus_tokens}" if focus_tokens is not None else "") + "}"
    return f"index{{indexed={str(fresh['indexed']).lower()}{age}}}\n{cost}"
