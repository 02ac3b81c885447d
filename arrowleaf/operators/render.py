"""Programs as Python source in a catalogue of 62 styles, a row a program and style.

Expressions are templates whose hole ``_`` is filled on the syntax tree, so the parser's own printer
sets parentheses.  Which styles apply is a filter over an array literal: no join and no shuffle.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .corpus import rotated

#: The expression of each operation over ``_``.
TEMPLATES = {
    "filter:even": "_ % 2 == 0", "filter:odd": "_ % 2 != 0", "filter:gt_k": "_ > k", "filter:ge_k": "_ >= k", "filter:lt_k": "_ < k", "filter:le_k": "_ <= k",
    "filter:multiple_of_k": "_ % k == 0", "filter:positive": "_ > 0", "filter:negative": "_ < 0", "filter:zero": "_ == 0",
    "map:add_k": "_ + k", "map:sub_k": "_ - k", "map:mul_k": "_ * k", "map:negate": "-_", "map:abs": "abs(_)", "map:square": "_ ** 2", "map:mul_const:2": "_ * 2", "map:mul_const:3": "_ * 3",
    "order:ascending": "sorted(_)", "order:descending": "sorted(_, reverse=True)", "order:reverse": "_[::-1]",
    "slice:take_first_k": "_[:k]", "slice:take_last_k": "_[-k:]", "slice:step_2": "_[::2]",
}
IN_PLACE = {"order:ascending": "{0}.sort()", "order:descending": "{0}.sort(reverse=True)", "order:reverse": "{0}.reverse()"}
EXPLICIT, EXPLICIT_IN_PLACE = "list(reversed(_))", "{0} = {0}[::-1]"
#: The element, the accumulator, a name for each kind of stage, the spare list.
NAMES = {
    "default": ("x", "result", ("kept", "mapped", "ordered", "picked"), "tmp"),
    "terse": ("v", "out", ("sel", "conv", "srt", "cut"), "nxt"),
    "verbose": ("value", "values", ("filtered", "transformed", "reordered", "trimmed"), "collected"),
}
#: Comments by the kinds in a stage, and words for the overview.
COMMENTS = {"f": "# 条件に合う要素だけを残す", "m": "# 各要素を変換する", "fm": "# 条件に合う要素を変換して集める", "o": "# 並べ替える", "s": "# 必要な範囲を取り出す"}
COPY = "# 元のリストを複製する"
OVERVIEW = {"f": "抽出", "m": "変換", "o": "並べ替え", "s": "切り出し"}
#: Style names by (loop, temporaries); in each, the three name schemes, typed and then bare.
STYLE_NAMES = {
    (False, "none"): "list_comprehension list_comprehension_default_bare list_comprehension_terse_typed list_comprehension_bare list_comprehension_verbose_typed list_comprehension_verbose_bare",
    (False, "reused"): "comprehension_steps comprehension_steps_default_bare comprehension_steps_terse_typed comprehension_steps_bare comprehension_steps_verbose_typed comprehension_steps_verbose_bare",
    (False, "staged"): "comprehension_staged_typed comprehension_staged_default_bare comprehension_staged_terse_typed comprehension_staged_terse_bare comprehension_staged_verbose_typed comprehension_staged",
    (True, "reused"): "for_loop for_loop_default_bare for_loop_terse_typed for_loop_bare for_loop_verbose_typed for_loop_verbose_bare",
    (True, "staged"): "for_loop_staged_default_typed for_loop_staged_default_bare for_loop_staged_terse_typed for_loop_staged_bare for_loop_staged for_loop_staged_verbose_bare",
}


@dataclass(frozen=True)
class Style:
    name: str
    loop: bool
    temporaries: str
    names: str
    typed: bool
    comments: bool = False
    explicit: bool = False
    needs: tuple[str, ...] = ()  # one of these tags or categories has to occur


def _catalogue() -> tuple[Style, ...]:
    out = []
    for (loop, temporaries), names in STYLE_NAMES.items():
        for at, name in enumerate(names.split()):
            # without an element variable only two of the one-expression styles differ
            needs = ("filter", "map") if temporaries == "none" and at not in (0, 3) else ()
            for comments in (False, True):
                out.append(Style(name + "_commented" * comments, loop, temporaries, tuple(NAMES)[at // 2], at % 2 == 0, comments, needs=needs))
    reverse = ("order:reverse",)
    out.append(Style("explicit_reverse", False, "none", "terse", False, explicit=True, needs=reverse))
    out.append(Style("for_loop_explicit_reverse", True, "reused", "default", False, True, True, reverse))
    return tuple(out)


STYLES = _catalogue()


class _Fill(ast.NodeTransformer):
    def __init__(self, value: ast.expr | None = None):
        self.value = value

    def visit_Name(self, node):
        return self.value if node.id == "_" and self.value is not None else node

    def visit_UnaryOp(self, node):
        self.generic_visit(node)
        if isinstance(node.operand, ast.UnaryOp):  # -(-x), not --x
            node.operand = ast.Name(f"({ast.unparse(node.operand)})")
        return node


@lru_cache(1 << 16)
def fill(template: str, operand: str) -> str:
    """The template with its hole filled, parenthesised where needed."""
    parsed = lambda text: ast.parse(text, mode="eval").body
    return ast.unparse(_Fill(_Fill().visit(parsed(operand))).visit(parsed(template)))


def stages(tags: list[str], fuse: bool = True) -> list[tuple[str, list[str]]]:
    """(kinds, tags) of each statement: filters and then maps, a run of slices, or one ordering."""
    kinds = "".join(t[0] for t in tags)
    return [(m.group(), tags[m.start() : m.end()]) for m in re.finditer("f+m*|m+|s+|o" if fuse else ".", kinds)]


def _chain(tags: list[str], value: str, explicit: bool = False) -> str:
    for t in tags:
        value = fill(EXPLICIT if explicit and t == "order:reverse" else TEMPLATES[t], value)
    return value


def _parts(tags: list[str], x: str) -> tuple[str, str]:
    """The element and the condition of a stage over x."""
    return _chain([t for t in tags if t[0] == "m"], x), " and ".join(fill(TEMPLATES[t], x) for t in tags if t[0] == "f")


def render(tags: list[str], style: Style) -> str:
    """The source of ``solve(xs, k)``."""
    x, result, of_kind, spare = NAMES[style.names]
    staged = style.temporaries == "staged"
    lines: list[str] = ["def solve(xs: list[int], k: int) -> list[int]:" if style.typed else "def solve(xs, k):"]
    known: set[str] = set()
    uses: Counter = Counter()

    def say(*text: str) -> None:
        lines.extend("    " + t for t in text)

    def note(text: str) -> None:
        if style.comments:
            say(text)

    def let(name: str, value: str) -> str:
        say(f"{name}: list[int] = {value}" if style.typed and name not in known else f"{name} = {value}")
        known.add(name)
        return name

    def name_for(kinds: str) -> str:
        if not staged:
            return result
        base = of_kind["fmos".index(kinds[0])]
        uses[base] += 1
        return f"{base}_{uses[base]}" if uses[base] > 1 else base

    def value_of(kinds: str, ops: list[str], source: str) -> str:
        if kinds[0] in "os":
            return _chain(ops, source, style.explicit)
        element, condition = _parts(ops, x)
        return f"[{element} for {x} in {source}{' if ' * bool(condition)}{condition}]"

    at = "xs"
    todo = stages(tags, fuse=style.loop or not staged)
    if style.temporaries == "none":
        note("# " + "→".join(OVERVIEW[t[0]] for t in tags) + "の順に処理する")
    elif style.loop and todo[0][0][0] in "os":
        note(COPY)
        at = let(result, "list(xs)")
    for kinds, ops in todo:
        if style.temporaries == "none":
            at = value_of(kinds, ops, at)
            continue
        note(COMMENTS["".join(dict.fromkeys(kinds))])
        if style.loop and kinds[0] in "fm":
            target = name_for(kinds)
            element, condition = _parts(ops, x)
            filled = let(spare if target == at else target, "[]")
            push = f"{filled}.append({element})"
            say(f"for {x} in {at}:", *([f"    if {condition}:", f"        {push}"] if condition else [f"    {push}"]))
            at = target if filled == target else let(target, filled)
        elif style.loop and kinds == "o" and not staged:
            say((EXPLICIT_IN_PLACE if style.explicit and ops[0] == "order:reverse" else IN_PLACE[ops[0]]).format(at))
        else:
            at = let(name_for(kinds), value_of(kinds, ops, at))
    say(f"return {at}")
    return "\n".join(lines) + "\n"


@F.pandas_udf(StringType())
def _render(tags: pd.Series, style: pd.Series) -> pd.Series:
    return pd.Series([render(list(t), STYLES[s]) for t, s in zip(tags, style, strict=True)], dtype=object)


def applicable(tags: str = "tags", categories: str = "categories") -> Column:
    """The numbers of the styles that the program exercises, in catalogue order."""
    all_styles = F.array(*[F.struct(F.lit(i).alias("at"), F.array(*map(F.lit, s.needs)).cast("array<string>").alias("needs")) for i, s in enumerate(STYLES)])
    have = F.concat(tags, categories)
    return F.transform(F.filter(all_styles, lambda s: (F.size(s["needs"]) == 0) | F.arrays_overlap(s["needs"], have)), lambda s: s["at"])


def variants(programs: DataFrame, n: int | None = None) -> DataFrame:
    """(pos, semantic_hash, code_style, code, code_sha256): all or n styles of each program, turned by its hash."""
    p = programs.withColumn("_all", applicable()).withColumn("_s", F.explode(rotated("_all", "semantic_hash", n)))
    name = F.element_at(F.array(*[F.lit(s.name) for s in STYLES]), F.col("_s") + 1)
    out = p.select("pos", "semantic_hash", name.alias("code_style"), _render("tags", "_s").alias("code"))
    return out.withColumn("code_sha256", F.sha2("code", 256))


def replay_faults(stored: DataFrame, programs: DataFrame) -> DataFrame:
    """Stored snippets (semantic_hash, code_style, code) that their program and style no longer render to."""
    style = F.array_position(F.array(*[F.lit(s.name) for s in STYLES]), F.col("code_style")).cast("int") - 1
    both = stored.withColumn("_s", style).join(programs.select("semantic_hash", "tags"), "semantic_hash", "left")
    known = both.where((F.col("_s") >= 0) & F.col("tags").isNotNull())
    unknown = both.where(F.coalesce(F.col("_s") < 0, F.lit(True)) | F.col("tags").isNull()).withColumn("rendered", F.lit(None).cast("string"))
    shown = unknown.unionByName(known.withColumn("rendered", _render("tags", "_s")))
    return shown.where(~F.col("rendered").eqNullSafe(F.col("code")) | F.col("rendered").isNull()).select("semantic_hash", "code_style", "code", "rendered")
