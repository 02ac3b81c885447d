"""Expression dictionaries as long tables (key, idx, text): pools, and checks that return the offending rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .instructions import ADNOMINAL, KEYS, PAIRS, TEXTS


def pools(entries: DataFrame, seed: str, share: float = 0.25) -> DataFrame:
    """``entries`` with ``pool``: a share of each key's expressions, at least one, is reserved; one at least is left.

    Keys of a single expression and frames are shared.  The order is that of a seeded hash.
    """
    own = W.partitionBy("key")
    by_hash = own.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "key", "idx"), 256), "idx")
    d = entries.withColumns({"_n": F.count(F.lit(1)).over(own), "_r": F.row_number().over(by_hash)})
    take = F.least(F.greatest(F.lit(1.0), F.rint(F.col("_n") * share)), F.col("_n") - 1.0)
    shared = (F.col("_n") < 2) | F.col("key").startswith("frame:")
    return d.withColumn("pool", F.when(shared, "shared").when(F.col("_r") <= take, "reserved").otherwise("train")).drop("_n", "_r")


def outside(choices: DataFrame, pooled: DataFrame, pool: str) -> DataFrame:
    """Recorded choices (key, idx, ...) of expressions that are neither in ``pool`` nor shared."""
    allowed = pooled.where(F.col("pool").isin(pool, "shared")).select("key", "idx")
    return choices.join(allowed, ["key", "idx"], "left_anti")


def missing(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Keys without any expression."""
    return keys.select("key").join(entries.select("key"), "key", "left_anti")


def repeated(entries: DataFrame) -> DataFrame:
    """(key, text, n) of expressions that a key holds more than once."""
    return entries.groupBy("key", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def table(spark: SparkSession, entries: dict) -> DataFrame:
    """(key, slot_type, idx, text, terminal, te) of a dictionary {key: {slot_type, expressions}}."""
    rows = []
    for key, entry in entries.items():
        for i, e in enumerate(entry.get("expressions") or [None]):
            pair = e if isinstance(e, dict) else {}
            rows.append((key, entry.get("slot_type"), i if entry.get("expressions") else None, e if isinstance(e, str) else None, pair.get("terminal"), pair.get("te")))
    return spark.createDataFrame(rows, "key string, slot_type string, idx int, text string, terminal string, te string")


def from_expressions(expressions: dict) -> dict:
    """A dictionary of plain lists of texts and (terminal, te) pairs, with the slot type of each known key."""
    return {k: {"slot_type": slot_type(k), "expressions": [{"terminal": e[0], "te": e[1]} if isinstance(e, tuple) else e for e in v]} for k, v in expressions.items()}


def slot_type(key: str) -> str | None:
    return "ADNOMINAL" if key in ADNOMINAL else "ACTION_PAIR" if key in PAIRS else "TEXT" if key in TEXTS else None


def _ordered(entries: dict) -> dict:
    return {k: entries[k] for k in (*[k for k in KEYS if k in entries], *[k for k in entries if k not in KEYS])}


def load(spark: SparkSession, path: str, strict: bool = True) -> dict:
    """The dictionary of a JSON file, on the driver: some hundred expressions.  ``strict`` raises on unfit entries."""
    try:
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)
    except FileNotFoundError:
        raise ValueError(f"no dictionary at {path}") from None
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is not JSON: {e}") from None
    if not isinstance(entries, dict):
        raise ValueError(f"{path} holds no object of keys")
    if strict and (found := structure_faults(table(spark, entries)).collect()):
        raise ValueError(f"{path}: " + "; ".join(f"{r.key}[{r.idx}] {r.rule}" for r in found))
    return entries


def save(entries: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(_ordered(entries), ensure_ascii=False, indent=2) + "\n")


def content_sha256(entries: dict) -> str:
    text = json.dumps(_ordered(entries), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def _rules(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, idx, rule) of every rule that a row breaks, in one pass."""
    hits = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]), lambda r: r.isNotNull())
    return rows.select("key", "idx", F.explode(hits).alias("rule"))


def structure_faults(rows: DataFrame) -> DataFrame:
    """(key, idx, rule): entries of an unfit shape, from the rows of ``table``."""
    want = F.create_map(*[F.lit(x) for k in KEYS for x in (k, slot_type(k))])
    slot = F.try_element_at(want, F.col("key"))
    pair, some = slot == "ACTION_PAIR", F.col("idx").isNotNull()
    marks = lambda c: (F.length(c) - F.length(F.replace(F.col(c), F.lit("{frag}")))) / 6
    frame = F.col("key") == "frame:filter_verb"
    whole = F.col("terminal").isNotNull() & F.col("te").isNotNull()
    return _rules(
        rows,
        [
            ("unknown key", slot.isNull()),
            ("slot type", slot.isNotNull() & ~F.col("slot_type").eqNullSafe(slot)),
            ("no expressions", slot.isNotNull() & ~some),
            ("not a text", some & ~pair & F.col("text").isNull()),
            ("empty text", some & ~pair & (F.trim("text") == "")),
            ("missing form", some & pair & ~whole),
            ("empty form", some & pair & whole & ((F.trim("terminal") == "") | (F.trim("te") == ""))),
            ("one placeholder", some & frame & whole & ((marks("terminal") != 1) | (marks("te") != 1))),
        ],
    )


#: Endings and words that keep an expression from joining its neighbours.
NOUNS = ("要素", "もの", "物", "値", "数", "こと", "事", "とき", "操作", "処理", "動作", "方法", "行為")
NARROWING = ("だけ", "のみ", "を残す", "を抽出", "を選ぶ")
PARTICLES = ("から", "まで", "より", "へ", "に", "を", "と", "は", "が", "で")
FROM = ("から", "より")


def contract_faults(rows: DataFrame) -> DataFrame:
    """(key, idx, rule): well-formed expressions that the sentences cannot join, from the rows of ``table``."""
    key, text, terminal, te = F.col("key"), F.col("text"), F.col("terminal"), F.col("te")
    ends = lambda c, of: c.rlike("(" + "|".join(of) + ")$")
    adnominal, pairs = key.isin(*ADNOMINAL), key.isin(*PAIRS) & terminal.isNotNull() & te.isNotNull()
    opening, closing = key == "frame:opening", key == "frame:closing"
    body = F.regexp_replace(F.rtrim(text), "、+$", "")
    chained = pairs & (key.startswith("map:") | key.startswith("slice:"))
    late = lambda c: F.contains(c, F.lit("{frag}")) & ~c.startswith("{frag}")
    return _rules(
        rows,
        [
            ("ends in a noun", adnominal & ends(text, NOUNS)),
            ("ends in a particle", adnominal & ~ends(text, NOUNS) & ends(text, PARTICLES)),
            ("narrows twice", adnominal & text.rlike("|".join(NARROWING))),
            ("terminal ends in a noun", pairs & ends(terminal, NOUNS)),
            ("terminal is a te form", pairs & ~ends(terminal, NOUNS) & ends(terminal, ("て", "で"))),
            ("text before the placeholder", pairs & (key == "frame:filter_verb") & (late(terminal) | late(te))),
            ("te equals terminal", pairs & (te == terminal)),
            ("te has the connective", chained & te.endswith("から")),
            ("te is no te form", chained & ~te.endswith("から") & ~ends(te, ("て", "で"))),
            ("opening ends the sentence", opening & body.endswith("。")),
            ("opening takes from the list", opening & ends(body, FROM)),
            ("closing does not end the sentence", closing & ~F.rtrim(text).endswith("。")),
            ("closing does not name solve", closing & ~F.contains(text, F.lit("solve"))),
        ],
    )
