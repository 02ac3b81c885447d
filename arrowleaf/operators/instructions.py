"""Programs told in Japanese: expressions chosen by hash, four sentence types, replay from the choices.

The dictionary is small and fixed, so it is one map literal in the plan; choosing and telling are column
expressions without joins.  A row's choices are numbers in columns, so a replay is the telling alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys by the kind of their expressions, sentence types, and the words between clauses.
ADNOMINAL = ("filter:even", "filter:odd", "filter:gt_k", "filter:ge_k", "filter:lt_k", "filter:le_k", "filter:multiple_of_k", "filter:positive", "filter:negative", "filter:zero")
PAIRS = (
    "map:add_k", "map:sub_k", "map:mul_k", "map:negate", "map:abs", "map:square", "map:mul_const",
    "order:ascending", "order:descending", "order:reverse", "slice:take_first_k", "slice:take_last_k", "slice:step_2", "frame:filter_verb",
)
TEXTS = ("frame:opening", "frame:closing")
KEYS = (*ADNOMINAL, *PAIRS, *TEXTS)
SENTENCES = ("sequential", "ordinal", "procedure", "goal_first")
GLUE = {
    "first": ("まず", "最初に", "はじめに"), "middle": ("次に", "続いて", "その後", "それから"), "last": ("最後に", "最終的に"),
    "lead": ("次の手順で処理する", "以下の手順で処理する", "次の順に処理を行う"), "style": ("words", "numbers"), "goal_lead": ("ただし、", "その際、"), "goal_tail": ("こと。", "ようにしてください。"),
}
COMMA, STOP, CHAIN, BEFORE = "、", "。", "から", "前に"

#: A small dictionary of the library's own: key -> texts, or (terminal, te) pairs.
OWN = {
    "filter:even": ["偶数の", "2で割り切れる"], "filter:odd": ["奇数の", "2で割り切れない"], "filter:gt_k": ["kより大きい", "kを超える"], "filter:ge_k": ["k以上の"],
    "filter:lt_k": ["kより小さい", "k未満の"], "filter:le_k": ["k以下の"], "filter:multiple_of_k": ["kの倍数の", "kで割り切れる"], "filter:positive": ["正の", "0より大きい"],
    "filter:negative": ["負の", "0より小さい"], "filter:zero": ["0の", "0に等しい"],
    "map:add_k": [("kを足す", "kを足して"), ("kだけ増やす", "kだけ増やして")], "map:sub_k": [("kを引く", "kを引いて"), ("kだけ減らす", "kだけ減らして")], "map:mul_k": [("k倍する", "k倍して"), ("kを掛ける", "kを掛けて")],
    "map:negate": [("符号を反転する", "符号を反転して")], "map:abs": [("絶対値にする", "絶対値にして"), ("絶対値を取る", "絶対値を取って")], "map:square": [("2乗する", "2乗して")],
    "map:mul_const": [("N倍する", "N倍して"), ("Nを掛ける", "Nを掛けて")],
    "order:ascending": [("昇順に並べる", "昇順に並べて"), ("小さい順に並べ替える", "小さい順に並べ替えて")], "order:descending": [("降順に並べる", "降順に並べて")], "order:reverse": [("並びを逆にする", "並びを逆にして")],
    "slice:take_first_k": [("先頭からk個を取り出す", "先頭からk個を取り出して")], "slice:take_last_k": [("末尾からk個を取り出す", "末尾からk個を取り出して")], "slice:step_2": [("先頭から1個おきに取り出す", "先頭から1個おきに取り出して")],
    "frame:filter_verb": [("{frag}要素だけを残す", "{frag}要素だけを残して"), ("{frag}要素を選び出す", "{frag}要素を選び出して")],
    "frame:opening": ["整数のリストxsについて、", "リストxsに対して"], "frame:closing": ["solve関数を書いてください。", "関数solve(xs, k)を作ってください。"],
}


def dictionary_key(tag: Column) -> Column:
    """The key of an operation: its tag without a constant."""
    return F.substring_index(tag, ":", 2)


def _literal(entries: dict) -> Column:
    """key -> array of (terminal, te); plain texts are their own te."""
    two = lambda e: (e, e) if isinstance(e, str) else e
    parts = []
    for key, expressions in entries.items():
        parts += [F.lit(key), F.array(*[F.struct(F.lit(a).alias("terminal"), F.lit(b).alias("te")) for a, b in map(two, expressions)])]
    return F.create_map(*parts)


def _draw(hash_: str, seed: int, attempt: Column, slot: Column, n: Column) -> Column:
    text = F.concat_ws(":", F.col(hash_), F.lit(str(seed)), attempt.cast("string"), slot)
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % n).cast("int")


def chosen(programs: DataFrame, entries: dict = OWN, allowed: dict[str, list[int]] | None = None, seed: int = 0, attempts: int = 1, sentences: tuple[str, ...] = SENTENCES) -> DataFrame:
    """``programs`` (semantic_hash, tags, ...) a row an attempt, with ``choice``, a struct of numbers.

    ``allowed`` restricts a key to some of its expressions.  A key that a program needs and that has none
    left raises.
    """
    if bad := set(sentences) - set(SENTENCES):
        raise ValueError(f"unknown sentence types {sorted(bad)}")
    room = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in (allowed or {}).get(k, range(len(v)))]).cast("array<int>"))])

    def pick(slot: Column, key: Column) -> Column:
        own = F.try_element_at(room, key)
        none = F.coalesce(F.size(own) < 1, F.lit(True))
        return F.when(none, F.raise_error(F.concat(F.lit("no expression for "), key)).cast("int")).otherwise(F.get(own, _draw("semantic_hash", seed, F.col("attempt"), slot, F.size(own))))

    some = F.array(*[F.lit(SENTENCES.index(s)) for s in SENTENCES if s in sentences])
    fits = F.when(F.size("tags") > 1, some).otherwise(F.filter(some, lambda s: s == 0))
    kind = F.when(F.size(fits) < 1, F.raise_error(F.lit("no sentence type applies")).cast("int")).otherwise(F.get(fits, _draw("semantic_hash", seed, F.col("attempt"), F.lit("template"), F.size(fits))))
    ops = F.transform("tags", lambda t, i: pick(F.concat(F.lit("op"), i.cast("string")), dictionary_key(t)))
    frames = F.transform("tags", lambda t, i: F.when(t.startswith("filter:"), pick(F.concat(F.lit("frame"), i.cast("string")), F.lit("frame:filter_verb"))).otherwise(F.lit(-1)))
    glue = [_draw("semantic_hash", seed, F.col("attempt"), F.lit(g), F.lit(len(GLUE[g]))).alias(g) for g in GLUE]
    choice = F.struct(kind.alias("template"), pick(F.lit("opening"), F.lit("frame:opening")).alias("opening"), pick(F.lit("closing"), F.lit("frame:closing")).alias("closing"), ops.alias("ops"), frames.alias("frames"), *glue)
    return programs.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumn("choice", choice)


def _bare(text: Column, marks: str = COMMA) -> Column:
    return F.regexp_replace(text, f"[{marks}]+$", "")


def told(rows: DataFrame, entries: dict = OWN) -> DataFrame:
    """``rows`` (tags, choice, ...) with ``text``: the sentence of the program under its choices."""
    words = _literal(entries)

    def expression(key: Column, i: Column, form: str) -> Column:
        return F.get(F.try_element_at(words, key), i)[form]

    def unit(i: Column, form: str) -> Column:
        tag = F.get("tags", i)
        said = expression(dictionary_key(tag), F.get("choice.ops", i), form)
        frame = F.when(tag.startswith("filter:"), F.replace(expression(F.lit("frame:filter_verb"), F.get("choice.frames", i), form), F.lit("{frag}"), said))
        parts = F.split(tag, ":")
        return frame.otherwise(F.when(F.size(parts) > 2, F.replace(said, F.lit("N"), F.get(parts, F.lit(2)))).otherwise(said))

    def glue(name: str) -> Column:
        return F.get(F.array(*map(F.lit, GLUE[name])), F.col(f"choice.{name}"))

    n = F.size("tags")
    each = F.sequence(F.lit(0), n - 1)
    is_last = lambda i: i == n - 1
    form = lambda i: F.when(is_last(i), unit(i, "terminal")).otherwise(unit(i, "te"))
    kind = lambda i: F.substring_index(F.get("tags", i), ":", 1)
    runs_on = lambda i: (kind(i) == kind(i + 1)) & kind(i).isin("map", "slice")
    marker = lambda i: F.when(i == 0, glue("first")).when(is_last(i), glue("last")).otherwise(glue("middle"))
    opening = F.concat(_bare(expression(F.lit("frame:opening"), F.col("choice.opening"), "terminal")), F.lit(COMMA))
    closing = F.regexp_replace(expression(F.lit("frame:closing"), F.col("choice.closing"), "terminal"), f"^{COMMA}+", "")
    link = lambda i: F.when(is_last(i), _bare(unit(i, "terminal"))).when(runs_on(i), F.concat(unit(i, "te"), F.lit(CHAIN))).otherwise(F.concat(_bare(unit(i, "te")), F.lit(COMMA)))
    sequential = F.concat(opening, F.array_join(F.transform(each, link), ""), closing)
    ordinal = F.concat(opening, F.array_join(F.transform(each, lambda i: F.concat(marker(i), _bare(form(i)))), COMMA), closing)
    step = lambda i: F.concat(
        F.when(F.col("choice.style") == 1, F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "))).otherwise(F.concat(marker(i), F.lit(COMMA))), _bare(_bare(unit(i, "terminal")), STOP), F.lit(STOP)
    )
    procedure = F.concat(opening, glue("lead"), closing, F.array_join(F.transform(each, step), ""))
    final = _bare(unit(n - 1, "terminal"))
    earlier = F.transform(F.sequence(F.lit(0), n - 2), lambda i: _bare(F.when(i == n - 2, unit(i, "terminal")).otherwise(unit(i, "te"))))
    goal_first = F.concat(opening, final, closing, glue("goal_lead"), final, F.lit(BEFORE + COMMA), F.array_join(earlier, COMMA), glue("goal_tail"))
    at = F.col("choice.template")
    return rows.withColumn("text", F.when(at == 0, sequential).when(at == 1, ordinal).when(at == 2, procedure).when(n > 1, goal_first))


def renderings(programs: DataFrame, n: int, entries: dict = OWN, allowed: dict[str, list[int]] | None = None, seed: int = 0) -> DataFrame:
    """Up to n different sentences of each program in the order of their attempts: semantic_hash, at, text, choice.

    max(20, 10 n) attempts are made; of equal texts the first stays.
    """
    rows = told(chosen(programs.select("semantic_hash", "tags"), entries, allowed, seed, max(20, 10 * n)), entries)
    first = rows.groupBy("semantic_hash", "text").agg(F.min_by(F.struct("attempt", "choice"), "attempt").alias("r"))
    ranked = first.withColumn("at", F.row_number().over(W.partitionBy("semantic_hash").orderBy("r.attempt")) - 1)
    return ranked.where(F.col("at") < n).select("semantic_hash", "at", "text", F.col("r.choice").alias("choice"))


def replay_faults(stored: DataFrame, programs: DataFrame, entries: dict, sha256: str | None = None) -> DataFrame:
    """Stored sentences (semantic_hash, text, choice, dictionary_sha256) that their choices no longer spell.

    A choice outside the dictionary, another dictionary's hash, or a placeholder left in the text is a fault too.
    """
    size = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.lit(len(v)))])
    d = stored.join(programs.select("semantic_hash", "tags"), "semantic_hash", "left")
    keys = F.transform("tags", lambda t: F.try_element_at(size, dictionary_key(t)))
    fits = F.forall(F.arrays_zip(F.col("choice.ops").alias("i"), keys.alias("n")), lambda x: F.coalesce((x["i"] >= 0) & (x["i"] < x["n"]), F.lit(False)))
    fits = fits & F.forall("choice.frames", lambda i: i < len(entries.get("frame:filter_verb", ()))) & (F.col("choice.opening") < len(entries["frame:opening"])) & (F.col("choice.closing") < len(entries["frame:closing"]))
    known = F.coalesce(fits & F.col("tags").isNotNull(), F.lit(False))
    if sha256 is not None:
        known = known & F.col("dictionary_sha256").eqNullSafe(sha256)
    same = told(d.where(known).withColumnRenamed("text", "_stored"), entries)
    wrong = same.where(~F.col("text").eqNullSafe(F.col("_stored")) | F.contains("text", F.lit("{frag}"))).select("semantic_hash", F.col("_stored").alias("text"), F.lit("differs").alias("fault"))
    return wrong.unionByName(d.where(~known).select("semantic_hash", "text", F.lit("unknown choice or dictionary").alias("fault")))


def too_few(records: DataFrame) -> DataFrame:
    """Records (.., instructions, codes) with fewer sentences than codes."""
    return records.where(F.size("instructions") < F.size("codes"))
