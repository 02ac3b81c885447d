"""Programs of one to three list operations: values, identity, and execution-only rewrites."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

#: The closed vocabulary, in order.
VOCABULARY = (
    "filter:even", "filter:odd", "filter:gt_k", "filter:ge_k", "filter:lt_k", "filter:le_k", "filter:multiple_of_k", "filter:positive", "filter:negative", "filter:zero",
    "map:add_k", "map:sub_k", "map:mul_k", "map:negate", "map:abs", "map:square", "map:mul_const:2", "map:mul_const:3",
    "order:ascending", "order:descending", "order:reverse", "slice:take_first_k", "slice:take_last_k", "slice:step_2",
)
MAX_OPS = 3


@dataclass(frozen=True)
class Op:
    category: str
    name: str
    arg: int | None = None

    def __post_init__(self):
        if self.tag not in VOCABULARY:
            raise ValueError(f"unknown operation {self.tag}")

    @property
    def tag(self) -> str:
        return ":".join([self.category, self.name, *([str(self.arg)] if self.arg is not None else [])])

    @classmethod
    def parse(cls, tag: str) -> Op:
        category, name, *arg = tag.split(":")
        return cls(category, name, int(arg[0]) if arg else None)

    def to_json(self) -> list:
        return [self.category, self.name, *([self.arg] if self.arg is not None else [])]


@dataclass(frozen=True)
class Program:
    """Order and repetition are identity: nothing is normalised."""

    ops: tuple[Op, ...]

    def __post_init__(self):
        if not 1 <= len(self.ops) <= MAX_OPS:
            raise ValueError(f"a program has 1 to {MAX_OPS} operations")

    @classmethod
    def of(cls, *tags: str) -> Program:
        return cls(tuple(map(Op.parse, tags)))

    @classmethod
    def from_json(cls, text: str) -> Program:
        body = json.loads(text)
        if not isinstance(body, dict) or "ops" not in body:
            raise ValueError("a program is an object with ops")
        return cls(tuple(Op(*op) for op in body["ops"]))

    @property
    def tags(self) -> list[str]:
        return [o.tag for o in self.ops]

    @property
    def canonical_json(self) -> str:
        return json.dumps({"ops": [o.to_json() for o in self.ops]}, separators=(",", ":"), ensure_ascii=False)

    @property
    def semantic_hash(self) -> str:
        return hashlib.sha256(self.canonical_json.encode()).hexdigest()

    def seed(self, base: int) -> int:
        """The program's own seed for a run's seed."""
        return base ^ int(self.semantic_hash[:8], 16)


def rewrite(tags: list[str]) -> list[str]:
    """Shorter operations of equal results, for execution only; identity keeps the original."""
    out: list[str] = []
    for t in tags:
        last = out[-1] if out else ""
        if (t, last) in (("order:reverse", "order:reverse"), ("map:negate", "map:negate")):
            out.pop()
        elif t == last and (t.startswith("filter:") or t in ("slice:take_first_k", "slice:take_last_k", "order:ascending", "order:descending", "map:abs")):
            continue
        elif t in ("order:ascending", "order:descending") and last.startswith("order:") or t == "map:abs" and last == "map:negate":
            out[-1] = t
        else:
            out.append(t)
    return out


def interpret(tags: list[str], xs: list[int], k: int) -> list[int]:
    """Plain Python semantics, the yardstick of the tests."""
    keep = {
        "even": lambda x: x % 2 == 0, "odd": lambda x: x % 2 != 0, "gt_k": lambda x: x > k, "ge_k": lambda x: x >= k, "lt_k": lambda x: x < k, "le_k": lambda x: x <= k,
        "multiple_of_k": lambda x: x % k == 0, "positive": lambda x: x > 0, "negative": lambda x: x < 0, "zero": lambda x: x == 0,
    }
    change = {"add_k": lambda x: x + k, "sub_k": lambda x: x - k, "mul_k": lambda x: x * k, "negate": lambda x: -x, "abs": abs, "square": lambda x: x * x}
    xs = list(xs)
    for tag in tags:
        category, name, *arg = tag.split(":")
        if category == "filter":
            xs = [x for x in xs if keep[name](x)]
        elif category == "map":
            xs = [x * int(arg[0]) for x in xs] if arg else [change[name](x) for x in xs]
        elif category == "order":
            xs = xs[::-1] if name == "reverse" else sorted(xs, reverse=name == "descending")
        else:
            xs = {"take_first_k": xs[:k], "take_last_k": xs[-k:], "step_2": xs[::2]}[name]
    return xs
