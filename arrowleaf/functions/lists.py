"""Programs compiled to Spark column expressions over (xs array<bigint>, k bigint)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .program import VOCABULARY, rewrite

_TEST = {
    "even": "x % 2 = 0", "odd": "x % 2 <> 0", "gt_k": "x > {k}", "ge_k": "x >= {k}", "lt_k": "x < {k}", "le_k": "x <= {k}", "multiple_of_k": "x % {k} = 0",
    "positive": "x > 0", "negative": "x < 0", "zero": "x = 0",
}
_VALUE = {"add_k": "({x} + {k})", "sub_k": "({x} - {k})", "mul_k": "({x} * {k})", "negate": "(-{x})", "abs": "abs({x})", "square": "({x} * {x})"}


def _value(tag: str, x: str, k: str) -> str:
    name, *arg = tag.split(":")[1:]
    return f"({x} * {arg[0]}L)" if arg else _VALUE[name].format(x=x, k=k)


def _whole(tag: str, xs: str, k: str) -> str:
    return {
        "order:ascending": f"sort_array({xs})",
        "order:descending": f"sort_array({xs}, false)",
        "order:reverse": f"reverse({xs})",
        "slice:take_first_k": f"slice({xs}, 1, cast({k} as int))",
        "slice:take_last_k": f"slice({xs}, cast(greatest(size({xs}) - {k}, 0L) + 1 as int), cast({k} as int))",
        "slice:step_2": f"filter({xs}, (x, i) -> i % 2 = 0)",
    }[tag]


def stages(tags: list[str]) -> list[list[str]]:
    """Runs that one pass can do: filters then maps together, every order or slice by itself."""
    out: list[list[str]] = []
    for t in tags:
        kind = t.split(":")[0]
        last = out[-1][-1].split(":")[0] if out else ""
        if kind == "filter" and last == "filter" or kind == "map" and last in ("filter", "map"):
            out[-1].append(t)
        else:
            out.append([t])
    return out


def sql(tags: list[str], xs: str = "xs", k: str = "k", optimise: bool = True) -> str:
    """The SQL expression of a program; each fused stage is at most one filter and one transform."""
    expr = xs
    for stage in stages(rewrite(tags) if optimise else tags) if optimise else [[t] for t in tags]:
        tests = [_TEST[t.split(":")[1]].format(k=k) for t in stage if t.startswith("filter:")]
        maps = [t for t in stage if t.startswith("map:")]
        if tests:
            expr = f"filter({expr}, x -> {' AND '.join(tests)})"
        value = "x"
        for t in maps:
            if t == "map:square" and value != "x":  # a value named twice is computed once
                expr, value = f"transform({expr}, x -> {value})", "x"
            value = _value(t, value, k)
        if maps:
            expr = f"transform({expr}, x -> {value})"
        if not tests and not maps:
            expr = _whole(stage[0], expr, k)
    return expr


def run(tags: list[str], xs: str = "xs", k: str = "k", optimise: bool = True) -> Column:
    return F.expr(sql(tags, xs, k, optimise))


def run_each(tags: str = "tags", xs: str = "xs", k: str = "k") -> Column:
    """A program per row: fold the row's tags over its list."""
    cases = " ".join(f"WHEN '{t}' THEN {sql([t], 'acc', k, False)}" for t in VOCABULARY)
    return F.expr(f"aggregate({tags}, {xs}, (acc, t) -> CASE t {cases} ELSE raise_error('unknown operation') END)")
