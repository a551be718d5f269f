"""Text of transfer graphs, steps and profiles."""

from __future__ import annotations

from sluice.operators.graph import Directed, Relation, Transfer


def short(n: int) -> str:
    for unit, name in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        if n >= unit:
            return f"{n / unit:.1f}{name}"
    return str(n)


def dag(graph: Directed, relations: dict[int, Relation], column) -> str:
    """One line a relation, indented by level, with the columns that join it to its parents."""
    level = graph.levels()
    lines = []
    for r in sorted(level, key=lambda r: (level[r], -relations[r].size, r)):
        links = ", ".join(f"{relations[e.a].name}({', '.join(column(e.a, x) for x in e.cols_a)}) on {', '.join(column(r, x) for x in e.cols_b)}" for e in graph.parents(r))
        lines.append("  " * level[r] + f"{relations[r].name} [{short(relations[r].size)}B]" + (f" -> {links}" if links else " (root)"))
    return "\n".join(lines)


def tree(graph: Directed, relations: dict[int, Relation], column) -> str:
    """The rooted trees with branches drawn; each relation with the columns that join it to its parent."""
    lines: list[str] = []

    def draw(r: int, stem: str, link: str) -> None:
        lines.append(f"{stem}{relations[r].name} [{short(relations[r].size)}B]{link}")
        kids = sorted((e for e in graph.edges if e.a == r), key=lambda e: (-relations[e.b].size, e.b))
        under = stem[:-3] + ("   " if stem.endswith("`- ") else "|  ") if stem else ""
        for k, e in enumerate(kids):
            pairs = ", ".join(f"{column(e.b, y)} = {column(r, x)}" for x, y in zip(e.cols_a, e.cols_b, strict=True))
            draw(e.b, under + ("`- " if k == len(kids) - 1 else "|- "), f" on {pairs}")

    for root in graph.roots():
        draw(root, "", "")
    return "\n".join(lines)


def pair(t: Transfer, relations: dict[int, Relation]) -> str:
    return f"{relations[t.build].name} => {relations[t.probe].name} ({'forward' if t.forward else 'backward'})"


def steps(transfers: list[Transfer], relations: dict[int, Relation], column) -> str:
    lines = []
    for n, t in enumerate(transfers):
        names = lambda r, cols: ", ".join(column(r, x) for x in cols)
        way = "forward" if t.forward else "backward"
        source = f"USE {relations[t.reuse[0]].name}({column(*t.reuse)})" if t.reuse else f"CREATE_FILTER {relations[t.build].name}({names(t.build, t.build_cols)}) [{short(relations[t.build].size)}B]"
        lines.append(f"{n:3d} {way:8s} {source} => PROBE_FILTER {relations[t.probe].name}({names(t.probe, t.probe_cols)})")
    return "\n".join(lines)


def profile(entries: list[dict]) -> str:
    """A line a step, in the order of the passes, and totals. Rows in and out are there if profiling was on."""
    lines = ["step  pass          ms  keys      rows in   rows out  kept   filters"]
    total = {}
    for e in entries:
        seen = "rows_in" in e
        rows = f"{short(e['rows_in']):8s}  {short(e['rows_out']):8s}  {100 * e['rows_out'] / max(1, e['rows_in']):4.0f}%" if seen else f"{'-':8s}  {'-':8s}  {'-':>5s}"
        lines.append(f"{e['step']:4d}  {e['pass']:8s} {e['ms']:7.1f}  {short(e['keys']):8s}  {rows}  {e['build']} => {e['probe']}: {', '.join(e['filters']) or e.get('skipped', '-')}")
        held = total.setdefault(e["pass"], [0, 0.0, 0, 0])
        for k, v in enumerate((1, e["ms"], e.get("rows_in", 0), e.get("rows_out", 0))):
            held[k] += v
    lines += [f"{way}: {n} steps, {ms:.1f} ms" + (f", {short(a)} rows in, {short(b)} out ({100 * b / a:.0f}%)" if a else "") for way, (n, ms, a, b) in total.items()]
    return "\n".join(lines)
