"""Checks of rendered code, static and by running it: length, syntax, safety, signature, tests, purity.

Code is run in the Python worker with a few builtins and an alarm for each test.  That is enough for
sources that this library renders; code from elsewhere needs a process of its own.
"""

from __future__ import annotations

import ast
import builtins
import contextlib
import io
import signal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from .corpus import length_ok

#: Calls by name, methods, and syntax that a solution may use.
CALLS = frozenset("abs all any bool dict divmod enumerate filter float int len list map max min pow range reversed round set sorted sum tuple zip".split())
METHODS = frozenset("append clear copy count extend index insert pop remove reverse sort".split())
SYNTAX = tuple(
    getattr(ast, name)
    for name in (
        "Module FunctionDef arguments arg Return Assign AugAssign AnnAssign For While If Expr Pass Break Continue "
        "BoolOp BinOp UnaryOp Lambda IfExp Dict Set ListComp SetComp DictComp GeneratorExp comprehension Compare Call keyword Constant Attribute Subscript Starred Name List Tuple Slice "
        "Load Store And Or Add Sub Mult Div Mod Pow FloorDiv Invert Not UAdd USub Eq NotEq Lt LtE Gt GtE Is IsNot In NotIn"
    ).split()
)
STAGES = ("length_ok", "syntax_ok", "ast_safe", "executable", "tests_passed")


def _safe(tree: ast.AST) -> bool:
    for n in ast.walk(tree):
        if not isinstance(n, SYNTAX):
            return False
        match n:
            case ast.Name(id=name) if name.startswith("__"):
                return False
            case ast.Attribute(attr=name) if name not in METHODS:
                return False
            case ast.Call(func=ast.Name(id=name)) if name not in CALLS:
                return False
            case ast.Call(func=f) if not isinstance(f, ast.Name | ast.Attribute | ast.Lambda):
                return False
    return True


def _signed(tree: ast.Module) -> bool:
    """Whether ``solve(xs, k)`` is all there is."""
    match tree.body:
        case [ast.FunctionDef(name="solve", decorator_list=[], args=a) as f]:
            odd = a.defaults or a.kwonlyargs or a.posonlyargs or a.vararg or a.kwarg
            nested = any(isinstance(n, ast.FunctionDef) and n is not f for n in ast.walk(f))
            return not odd and not nested and [x.arg for x in a.args] == ["xs", "k"]
    return False


def problem(code: str | None) -> str | None:
    """The first stage that the code fails: syntax, safety or signature; None when it fails none."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "syntax"
    return None if _safe(tree) and _signed(tree) else "safety" if not _safe(tree) else "signature"


class _Late(Exception):
    pass


def _late(*_):
    raise _Late


def run_test(solve, xs: list[int], k: int, expected: list[int], seconds: float = 2.0) -> tuple[bool, bool, str | None]:
    """(passed, input left alone, error) of one call on a copy of the list."""
    own = list(xs)
    before = signal.signal(signal.SIGALRM, _late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            got, error = solve(own, k), None
        passed = bool(got == expected)
    except _Late:
        passed, error = False, "timeout"
    except MemoryError:
        passed, error = False, "memory_limit_exceeded"
    except Exception as e:  # noqa: BLE001 - whatever the code raises is its result
        passed, error = False, f"{type(e).__name__}: {e}"
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
    return passed, own == list(xs), error


def load(code: str):
    """``solve`` of code that passed the static checks, with no builtins beyond CALLS."""
    space = {"__builtins__": {c: getattr(builtins, c) for c in CALLS}}
    exec(compile(code, "<solve>", "exec"), space)  # noqa: S102
    return space["solve"]


def trial(code: str, tests, seconds: float = 2.0) -> tuple[bool, bool, bool | None, str | None, int]:
    """(executable, tests_passed, pure, error, failures) of statically sound code; ``tests`` hold xs, k, expected."""
    try:
        solve = load(code)
    except Exception as e:  # noqa: BLE001
        return False, False, None, f"load error: {type(e).__name__}: {e}", 0
    if not len(tests):
        return True, False, None, "no test cases to check against", 0
    results = [run_test(solve, [int(x) for x in t["xs"]], int(t["k"]), [int(x) for x in t["expected"]], seconds) for t in tests]
    passed, pure = all(r[0] for r in results), all(r[1] for r in results)
    failures = sum(not (r[0] and r[1]) for r in results)
    return True, passed, pure, None if failures == 0 else "output differs from the expected", failures


@F.pandas_udf(StringType())
def _problem(code: pd.Series) -> pd.Series:
    return code.map(problem)


_TRIAL = StructType([*(StructField(c, BooleanType()) for c in ("executable", "tests_passed", "pure")), StructField("error", StringType()), StructField("failures", IntegerType())])


@F.pandas_udf(_TRIAL)
def _trial(code: pd.Series, tests: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([trial(c, t) for c, t in zip(code, tests, strict=True)], columns=_TRIAL.names)


def checked(df: DataFrame, code: str = "code") -> DataFrame:
    """``df`` with length_ok, syntax_ok, ast_safe and signature_valid; a failed stage fails the later ones.

    ``ast_safe`` holds the signature too, as one static stage.
    """
    p = df.withColumn("length_ok", F.coalesce(length_ok(code), F.lit(False))).withColumn("_p", _problem(F.col(code)))
    ok = F.col("length_ok")
    return p.withColumns({"syntax_ok": ok & ~F.col("_p").eqNullSafe("syntax"), "ast_safe": ok & F.col("_p").isNull(), "signature_valid": ok & F.col("_p").isNull()}).drop("_p")


def verified(df: DataFrame, code: str = "code", tests: str = "tests") -> DataFrame:
    """``df`` through the whole funnel: static stages, then running the sound rows on their tests.

    ``tests`` is an array of (xs, k, expected).  Rows that fail a static stage are never run; their
    ``pure`` is null.
    """
    c = checked(df, code)
    sound = c.where("ast_safe").withColumn("_t", _trial(F.col(code), F.col(tests)))
    flags = ["executable", "tests_passed", "pure", "error", "failures"]
    sound = sound.select(*c.columns, *[F.col(f"_t.{f}").alias(f) for f in flags])
    why = F.when(~F.col("length_ok"), "length limit exceeded").when(~F.col("syntax_ok"), "syntax error").otherwise("unsafe code")
    never = c.where(~F.col("ast_safe")).select(
        *c.columns, F.lit(False).alias("executable"), F.lit(False).alias("tests_passed"), F.lit(None).cast("boolean").alias("pure"), why.alias("error"), F.lit(0).alias("failures")
    )
    return sound.unionByName(never)


def ok() -> Column:
    """Whether a verified row passed every stage and left its inputs alone."""
    out = F.coalesce(F.col("pure"), F.lit(False))
    for stage in STAGES:
        out = out & F.coalesce(F.col(stage), F.lit(False))
    return out
