"""A plan in words: sources, tables, columns, and how events follow each other."""

from __future__ import annotations

from typing import Any

from tabloom.plans.spec import Column, Law, Plan, Table


def number(x: Any) -> str:
    return f"{x:.4g}" if isinstance(x, float) else str(x)


def duration(seconds: float) -> str:
    """The largest unit that fits."""
    for unit, size in (("days", 86_400), ("h", 3_600), ("min", 60)):
        if seconds >= size:
            return f"{number(seconds / size)} {unit}"
    return f"{number(float(seconds))} s"


def law_text(law: Law) -> str:
    p = law.params
    try:
        match law.kind:
            case "categorical":
                top = sorted(zip(p["probs"], map(str, p["categories"]), strict=True), key=lambda x: -x[0])[:5]
                more = f", and {len(p['categories']) - 5} more" if len(p["categories"]) > 5 else ""
                return "one of " + ", ".join(f"{c} ({q:.0%})" for q, c in top) + more
            case "normal":
                return f"around {number(p['mean'])}, give or take {number(p['std'])}"
            case "lognormal":
                import math

                return f"around {number(math.exp(p['mu']))}, with a long tail (sigma {number(p['sigma'])})"
            case "uniform" | "uniform_int":
                return f"evenly from {number(p['low'])} to {number(p['high'])}"
            case "exponential":
                return f"mostly small, {number(1 / p['rate'])} on average"
            case "gamma":
                return f"positive, {number(p['shape'] * p['scale'])} on average"
            case "beta":
                return f"between 0 and 1, {number(p['a'] / (p['a'] + p['b']))} on average"
            case "datetime_uniform":
                return f"any time from {p['start']} to {p['end']}"
            case "zipf":
                return f"one of {p['n']}, the first most often (exponent {number(p['a'])})"
    except (KeyError, TypeError, ValueError, ZeroDivisionError, OverflowError):
        pass
    return law.kind


def delay_text(law: Law) -> str:
    import math

    p = law.params
    match law.kind:
        case "lognormal":
            return f"about {duration(math.exp(p['mu']))} later"
        case "exponential":
            return f"{duration(1 / p['rate'])} later on average"
        case "normal":
            return f"about {duration(max(p['mean'], 0))} later"
    return f"later ({law_text(law)} seconds)"


def cardinality_text(law: Law) -> str:
    p = law.params
    match law.kind:
        case "poisson":
            return f"{number(p['lam'])} on average, at most {p['max']}"
        case "fixed":
            return f"always {p['n']}"
        case "bernoulli":
            return f"one for {p['p']:.0%} of parents"
        case "uniform_int":
            return f"from {p['low']} to {min(p['high'], p['max'])}"
    return law.kind


def column_text(t: Table, c: Column) -> str:
    if c.generator == "key":
        text = "unique key"
    elif c.generator == "parent_key":
        text = f"key of the {t.parent} row it belongs to"
    elif c.inherits:
        text = f"copied from {t.parent}.{c.inherits}"
    elif c.temporal is not None:
        text = f"after {c.temporal.anchor}, {delay_text(c.temporal.law)}"
    elif c.document is not None:
        text = f"{c.document.kind.upper()} of {', '.join(t.payload_columns(c.name))}"
    elif c.reference is not None:
        text = f"row of {c.reference}, {law_text(c.distribution)}"
    else:
        text = law_text(c.distribution)
    notes = [f"kept within {number(c.clamp[0])} and {number(c.clamp[1])}"] if c.clamp else []
    notes += [f"{c.null_rate:.2%} empty"] if c.null_rate else []
    return text + "".join(f"; {n}" for n in notes)


def event_chains(t: Table) -> list[list[str]]:
    """Paths of events from one that follows none in the table to one that none follows."""
    after: dict[str, list[str]] = {}
    for c in t.columns.values():
        if c.temporal is not None:
            after.setdefault(c.temporal.anchor, []).append(c.name)
    starts = [a for a in after if "." in a or t.columns[a].temporal is None]

    def paths(at: str) -> list[list[str]]:
        return [[at, *rest] for n in after[at] for rest in paths(n)] if at in after else [[at]]

    return [p for s in starts for p in paths(s)]


def _table(plan: Plan, t: Table) -> list[str]:
    head = f"{t.rows} rows" if t.role == "root" else f"for each {t.parent} row: {cardinality_text(t.cardinality)}"
    lines = [f"### {t.name}", "", f"{head}.", ""]
    lines += [f"- {c.name} ({c.type}): {column_text(t, c)}" for c in t.columns.values()]
    lines += [f"- {d.name}: {d.expr}" for d in t.derived]
    lines += [f"- {' and '.join(g.columns)} vary together (group {g.name})" for g in t.copulas]
    lines += [f"- events: {' -> '.join(p)}" for p in event_chains(t)]
    if t.format is not None:
        lines.append(f"- written as {t.format.kind}" + (f" with {', '.join(n.name for n in t.format.nest)} inside" if t.format.nest else ""))
    return [*lines, ""]


def explain(plan: Plan) -> str:
    """The plan as Markdown, tables grouped by source."""
    lines = ["# Generation plan", "", f"Seed {plan.seed}, {len(plan.tables)} tables.", ""]
    groups: dict[str, list[str]] = {}
    for n in plan.order():
        groups.setdefault(plan.tables[n].source or "", []).append(n)
    for source, names in groups.items():
        lines += [f"## Source {source}" if source else "## Tables", ""]
        for n in names:
            lines += _table(plan, plan.tables[n])
    lines += ["All rows are drawn from the laws above; none is a copy of a real row. Category lists and date ranges may come from real data as they are.", ""]
    return "\n".join(lines)
