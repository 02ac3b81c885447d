"""Registered queries of the library, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from arrowleaf.functions.lists import run, run_each
from arrowleaf.functions.program import VOCABULARY
from arrowleaf.operators import corpus, dictionary, instructions, render, verify
from arrowleaf.plans import cases, space
from arrowleaf.sources.tables import lists, table

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- the 24 operations, and programs -----------------------------------------------------------

_DUCK = {
    "filter:even": "list_filter({}, lambda x: x % 2 = 0)", "filter:odd": "list_filter({}, lambda x: x % 2 <> 0)", "filter:gt_k": "list_filter({}, lambda x: x > k)",
    "filter:ge_k": "list_filter({}, lambda x: x >= k)", "filter:lt_k": "list_filter({}, lambda x: x < k)", "filter:le_k": "list_filter({}, lambda x: x <= k)",
    "filter:multiple_of_k": "list_filter({}, lambda x: x % k = 0)", "filter:positive": "list_filter({}, lambda x: x > 0)", "filter:negative": "list_filter({}, lambda x: x < 0)",
    "filter:zero": "list_filter({}, lambda x: x = 0)", "map:add_k": "list_transform({}, lambda x: x + k)", "map:sub_k": "list_transform({}, lambda x: x - k)",
    "map:mul_k": "list_transform({}, lambda x: x * k)", "map:negate": "list_transform({}, lambda x: -x)", "map:abs": "list_transform({}, lambda x: abs(x))",
    "map:square": "list_transform({}, lambda x: x * x)", "map:mul_const:2": "list_transform({}, lambda x: x * 2)", "map:mul_const:3": "list_transform({}, lambda x: x * 3)",
    "order:ascending": "list_sort({})", "order:descending": "list_reverse_sort({})", "order:reverse": "list_reverse({})", "slice:take_first_k": "({})[1:k]",
    "slice:take_last_k": "({})[-k:]", "slice:step_2": "list_filter({}, lambda x, i: i % 2 = 1)",
}

_LISTS = """xk AS (
  SELECT o_orderkey, o_orderkey % 10 + 1 AS k,
         coalesce(list(l_quantity::BIGINT - 25 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT - 25) FILTER (WHERE l_orderkey IS NOT NULL), []::BIGINT[]) AS xs
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


def duck(tags, xs: str = "xs") -> str:
    for t in tags:
        xs = _DUCK[t].format(xs)
    return xs


def _program(name: str, *tags: str) -> None:
    def query(spark, sf_dir):
        d = lists(spark, sf_dir)
        return d.select("o_orderkey", "k", F.array_join(run(list(tags)), ",").alias("result"))

    query.__name__ = name
    _query(f"WITH {_LISTS} SELECT o_orderkey, k, array_to_string({duck(tags)}, ',') AS result FROM xk")(query)


for _t in VOCABULARY:
    _program("op_" + _t.replace(":", "_"), _t)
_program("prog_worked_example", "filter:even", "map:mul_const:2", "order:ascending")
_program("prog_reordered", "order:ascending", "slice:take_first_k", "filter:even")
_program("prog_fused_filters_maps", "filter:gt_k", "filter:odd", "map:add_k")
_program("prog_fused_maps", "map:add_k", "map:square", "map:mul_const:3")
_program("prog_filter_after_map", "map:negate", "filter:positive", "slice:take_last_k")
_program("prog_slice_chain", "slice:take_last_k", "slice:step_2", "order:reverse")
_program("prog_triple_square", "map:square", "map:square", "map:square")


def _step(i: str, xs: str) -> str:
    """SQL of the operation number ``i`` (null: none) over a list."""
    return f"CASE {i} " + " ".join(f"WHEN {n} THEN {duck([t], xs)}" for n, t in enumerate(VOCABULARY)) + f" ELSE {xs} END"


@_query(
    f"""WITH {_LISTS}, i AS (SELECT *, o_orderkey % 24 AS a, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey // 24) % 24 END AS b, CASE WHEN o_orderkey % 3 > 1 THEN (o_orderkey // 576) % 24 END AS c FROM xk),
one AS (SELECT *, {_step("a", "xs")} AS y FROM i), two AS (SELECT *, {_step("b", "y")} AS z FROM one)
SELECT o_orderkey, k, array_to_string({_step("c", "z")}, ',') AS result FROM two"""
)
def prog_data_dependent(spark, sf_dir):
    v = F.array(*map(F.lit, VOCABULARY))
    key = F.col("o_orderkey")
    tag = lambda x: F.element_at(v, (x % 24 + 1).cast("int"))
    digits = F.slice(F.array(tag(key), tag(F.floor(key / 24)), tag(F.floor(key / 576))), F.lit(1), (key % 3 + 1).cast("int"))
    return lists(spark, sf_dir).withColumn("tags", digits).select("o_orderkey", "k", F.array_join(run_each(), ",").alias("result"))


# --- the program space -------------------------------------------------------------------------


def _json_of(tag: str) -> str:
    category, name, *arg = tag.split(":")
    return f'["{category}","{name}"' + "".join(f",{a}" for a in arg) + "]"


_SPACE = (
    "v(i, tag, category, json) AS (VALUES " + ", ".join(f"({i}, '{t}', '{t.split(':')[0]}', '{_json_of(t)}')" for i, t in enumerate(VOCABULARY)) + "), "
    """p AS (
  SELECT i AS pos, 1 AS num_ops, [tag] AS tags, [category] AS categories, '{"ops":[' || json || ']}' AS canonical_json FROM v
  UNION ALL SELECT 24 + a.i * 24 + b.i, 2, [a.tag, b.tag], [a.category, b.category], '{"ops":[' || a.json || ',' || b.json || ']}' FROM v a CROSS JOIN v b
  UNION ALL SELECT 600 + (a.i * 24 + b.i) * 24 + c.i, 3, [a.tag, b.tag, c.tag], [a.category, b.category, c.category], '{"ops":[' || a.json || ',' || b.json || ',' || c.json || ']}'
  FROM v a CROSS JOIN v b CROSS JOIN v c),
h AS (SELECT *, sha256(canonical_json) AS semantic_hash, array_to_string(categories, '>') AS label FROM p)"""
)
_HELD = " OR ".join(f"(list_contains(tags, '{a}') AND list_contains(tags, '{b}'))" for a, b in space.HELD_OUT)


@_query(f"WITH {_SPACE} SELECT pos, num_ops, array_to_string(list_sort(tags), ',') AS op_tags, canonical_json, semantic_hash, ('0x' || semantic_hash[1:8])::BIGINT AS seed FROM h")
def ast_programs(spark, sf_dir):
    p = space.programs(spark)
    return p.select("pos", "num_ops", F.array_join(space.op_tags(), ",").alias("op_tags"), "canonical_json", "semantic_hash", space.seed_of("semantic_hash", 0).alias("seed"))


@_query(f"WITH {_SPACE} SELECT num_ops, label, count(*) AS n, count(DISTINCT semantic_hash) AS n_hashes FROM h GROUP BY 1, 2")
def ast_label_counts(spark, sf_dir):
    p = space.programs(spark).withColumn("label", F.array_join("categories", ">"))
    return p.groupBy("num_ops", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("semantic_hash").alias("n_hashes"))


@_query(f"WITH {_SPACE} SELECT ({_HELD}) AS held, count(*) AS n FROM h GROUP BY 1")
def ast_holdout_counts(spark, sf_dir):
    return space.programs(spark).groupBy(space.held_out().alias("held")).agg(F.count(F.lit(1)).alias("n"))


_QUOTA = """g AS (SELECT label, count(*) AS n, min(pos) AS first FROM {src} GROUP BY label),
u AS (SELECT *, round_even(sum(n::DOUBLE * {share}) OVER (ORDER BY first ROWS UNBOUNDED PRECEDING), 0) AS upto FROM g),
q AS (SELECT label, n, (upto - coalesce(lag(upto) OVER (ORDER BY first), 0))::BIGINT AS quota FROM u)"""


@_query(f"WITH {_SPACE}, r AS (SELECT * FROM h WHERE NOT ({_HELD})), " + _QUOTA.format(src="r", share="0.05") + " SELECT label, n, quota FROM q")
def ast_split_quotas(spark, sf_dir):
    p = space.programs(spark).where(~space.held_out()).withColumn("label", F.array_join("categories", ">"))
    return space.quotas(p, "label", "pos", 0.05)


def _cut(src: str, share: str, out: str) -> str:
    return _QUOTA.format(src=src, share=share).replace("g AS", f"g{out} AS").replace("FROM g)", f"FROM g{out})").replace("u AS", f"u{out} AS").replace("FROM u)", f"FROM u{out})").replace("q AS", f"{out} AS")


_SPLITS = (
    f"{_SPACE}, r AS (SELECT * FROM h WHERE NOT ({_HELD})), " + _cut("r", "0.05", "q5") + """,
n AS (SELECT r.*, q5.quota, row_number() OVER (PARTITION BY r.label ORDER BY sha256('0' || semantic_hash)) AS k FROM r JOIN q5 ON r.label = q5.label),
c AS (SELECT *, CASE WHEN k <= quota THEN 'test_paraphrase' WHEN k <= 2 * quota THEN 'test_boundary' ELSE 'train' END AS split FROM n),
rest AS (SELECT * FROM c WHERE split = 'train'), """ + _cut("rest", "0.1", "q1") + """,
m AS (SELECT rest.pos, rest.num_ops, rest.tags, rest.semantic_hash, q1.quota AS q, row_number() OVER (PARTITION BY rest.label ORDER BY sha256('0val' || semantic_hash)) AS k FROM rest JOIN q1 ON rest.label = q1.label),
s AS (SELECT pos, num_ops, tags, semantic_hash, 'test_compositional' AS split FROM h WHERE (""" + _HELD + """) UNION ALL
  SELECT pos, num_ops, tags, semantic_hash, split FROM c WHERE split <> 'train' UNION ALL
  SELECT pos, num_ops, tags, semantic_hash, CASE WHEN k <= q THEN 'val' ELSE 'train' END FROM m)"""
)


@_query(f"WITH {_SPLITS} SELECT split, num_ops, count(*) AS n FROM s GROUP BY 1, 2")
def ast_split_counts(spark, sf_dir):
    return space.splits(spark).groupBy("split", "num_ops").agg(F.count(F.lit(1)).alias("n"))


@_query(
    f"""WITH {_SPLITS}, w AS (SELECT unnest(tags) AS tag FROM s WHERE split = 'train')
SELECT (SELECT count(*) FROM (SELECT semantic_hash FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS leaked_hashes,
 (SELECT count(*) FROM s WHERE split <> 'test_compositional' AND ({_HELD})) + (SELECT count(*) FROM s WHERE split = 'test_compositional' AND NOT ({_HELD}))
 + (SELECT count(*) FROM (VALUES {", ".join(f"('{t}')" for t in sorted({t for p in space.HELD_OUT for t in p}))}) t(tag) WHERE tag NOT IN (SELECT tag FROM w)) AS holdout_faults"""
)
def ast_split_checks(spark, sf_dir):
    s = space.splits(spark)
    leaked = space.leaks(s, "semantic_hash", "split").agg(F.count(F.lit(1)).alias("leaked_hashes"))
    return leaked.crossJoin(space.holdout_faults(s).agg(F.count(F.lit(1)).alias("holdout_faults")))  # one row each


@_query(f"WITH {_SPACE} SELECT array_to_string(tags, ',') AS tags, count(*) AS n FROM h GROUP BY 1")
def ast_decoded(spark, sf_dir):
    return space.decoded(space.programs(spark).select("canonical_json")).groupBy(F.array_join("tags", ",").alias("tags")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_SPACE} SELECT label, count(*) AS n, min(pos) AS first, min_by(canonical_json, pos) AS canonical_json, sha256(string_agg(pos::VARCHAR, ',' ORDER BY pos)) AS members FROM h GROUP BY label")
def ast_first_per_label(spark, sf_dir):
    p = space.programs(spark).withColumn("label", F.array_join("categories", ">"))
    g = corpus.grouped_lists(p, "label", "pos", "pos").join(corpus.first_seen(p, F.col("label"), "label", "pos", "canonical_json"), "label")
    return g.select("label", F.col("n").cast("long").alias("n"), "first", "canonical_json", F.sha2(F.array_join("values", ","), 256).alias("members"))


@_query(f"WITH {_SPACE}, k AS (SELECT pos, unnest(tags || [label]) AS k FROM h), f AS (SELECT k, min(pos) AS pos FROM k GROUP BY k) SELECT DISTINCT pos FROM f")
def ast_coverage_sweep(spark, sf_dir):
    p = space.programs(spark).select("pos", F.concat("tags", F.array(F.array_join("categories", ">"))).alias("keys"))
    return corpus.sweep(p, "keys", "pos").select("pos")


def _drawn(what: str, low: int, high: int, n: int = 1) -> str:
    """SQL of a list drawn by hash, as ``cases.drawn`` has it."""
    return f"list_transform(range({n}), lambda i: ('0x' || sha256('0:{what}:' || i::VARCHAR)[1:8])::BIGINT % {high - low + 1} + {low})"


def _list(xs) -> str:
    if isinstance(xs, str):
        low, high, n = {"positive": (1, 100, 1), "negative": (-100, -1, 1), "longest": (-100, 100, 20)}[xs]
        return _drawn(xs, low, high, n)
    return f"{list(xs)}::BIGINT[]"


_INDEXED = _SPACE + ", d AS (SELECT pos, semantic_hash, categories, tags, CASE num_ops WHEN 1 THEN pos WHEN 2 THEN (pos - 24) // 24 ELSE (pos - 600) // 576 END AS a, CASE num_ops WHEN 2 THEN (pos - 24) % 24 WHEN 3 THEN (pos - 600) // 24 % 24 END AS b, CASE num_ops WHEN 3 THEN (pos - 600) % 24 END AS c FROM h)"
_CASES = "t(case_no, xs, k) AS (SELECT * FROM (VALUES " + ", ".join(f"({i * 3 + j}, {_list(xs)}, {k}::BIGINT)" for i, xs in enumerate(cases.BOUNDARY) for j, k in enumerate(cases.KS)) + "))"


def _results(src: str, upto: str = "3") -> str:
    """SQL steps from ``src`` (a, b, c, xs, k) to ``done`` with the list after at most ``upto`` operations."""
    return f"""one AS (SELECT *, {_step("a", "xs")} AS y FROM {src}), two AS (SELECT *, CASE WHEN {upto} > 1 THEN {_step("b", "y")} ELSE y END AS z FROM one),
done AS (SELECT *, CASE WHEN {upto} > 2 THEN {_step("c", "z")} ELSE z END AS result FROM two)"""


@_query(f"WITH {_INDEXED}, {_CASES}, w AS (SELECT * FROM d CROSS JOIN t), {_results('w')} SELECT pos, count(*) AS n, sha256(string_agg(array_to_string(result, ','), ';' ORDER BY case_no)) AS expected FROM done GROUP BY pos")
def boundary_cases(spark, sf_dir):
    p = space.programs(spark).select("pos", "tags").repartition("pos")
    d = cases.labelled(p.crossJoin(F.broadcast(cases.boundary(spark))))  # 14,424 programs, 36 fixed inputs
    rows = F.array_sort(F.collect_list(F.struct("case_no", F.array_join("expected", ",").alias("e"))))
    return d.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(rows, lambda r: r["e"]), ";"), 256).alias("expected"))


_REJECT = (
    "cand(cand, xs) AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {list(x)}::BIGINT[])" for i, x in enumerate(cases.REJECT)) + ")), kk(j, k) AS (SELECT * FROM (VALUES (0, 1::BIGINT), (1, 5), (2, 10))), "
    "w AS (SELECT d.*, list_position(categories, 'filter') AS upto, cand, xs, j, k FROM d CROSS JOIN cand CROSS JOIN kk WHERE list_contains(categories, 'filter')), "
)


@_query(f"WITH {_INDEXED}, {_REJECT} {_results('w', 'upto')} SELECT semantic_hash, cand, min_by(k, j) AS k FROM done WHERE len(result) = 0 GROUP BY 1, 2")
def reject_all_cases(spark, sf_dir):
    return cases.reject_all(space.programs(spark)).select("semantic_hash", "cand", "k")


_REJECT_OR_EMPTY = _REJECT.replace("FROM d CROSS JOIN cand", "FROM d CROSS JOIN (SELECT cand, xs FROM cand UNION ALL SELECT DISTINCT 100 + case_no // 3, xs FROM t WHERE len(xs) > 0) AS cand")


@_query(f"WITH {_INDEXED}, {_CASES}, {_REJECT_OR_EMPTY} {_results('w', 'upto')}, r AS (SELECT DISTINCT semantic_hash FROM done WHERE len(result) = 0) SELECT list_contains(categories, 'filter') AS has_filter, semantic_hash IN (SELECT semantic_hash FROM r) AS rejected, count(*) AS n FROM d GROUP BY 1, 2")
def reject_all_counts(spark, sf_dir):
    p = space.programs(spark)
    own = cases.boundary_suite(p).select("semantic_hash", F.explode("cases").alias("c")).select("semantic_hash", "c.xs", "c.k")
    hit = p.join(cases.has_reject_all(p, own), "semantic_hash")
    return hit.groupBy(F.array_contains("categories", "filter").alias("has_filter"), "rejected").agg(F.count(F.lit(1)).alias("n"))


# --- dedup, splits, joins and filters over documents --------------------------------------------


@_query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def docs_dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return space.dedup(d, "h", "doc_id").select("doc_id", "lang")


_DOCS = "d AS (SELECT doc_id, lang AS label, doc_id AS pos FROM documents)"


@_query(
    f"WITH {_DOCS}, " + _QUOTA.format(src="d", share="0.1") + """, r AS (
  SELECT d.*, row_number() OVER (PARTITION BY label ORDER BY sha256('0' || doc_id::VARCHAR)) AS r FROM d)
SELECT r.doc_id, r.label, CASE WHEN r.r <= q.quota THEN 'val' ELSE 'train' END AS split FROM r JOIN q ON r.label = q.label"""
)
def docs_split_assignment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("key"))
    return space.slice_rows(d, "label", "pos", "key", [("val", 0.1)], "0", "train").select("doc_id", "label", "split")


@_query("SELECT sha256(text) AS h, count(DISTINCT lang) AS n_splits FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def docs_leakage_pairs(spark, sf_dir):
    return space.leaks(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "lang"), "h", "lang")


@_query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def docs_labels_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@_query("SELECT d.doc_id, coalesce(l.quality, 20) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def docs_lookup_default(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.coalesce("quality", F.lit(20)).alias("quality"))


@_query(
    "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.quality = 1, false) AND coalesce(l.toxic = 0, true) AND d.n_chars <= 2000"
)
def docs_quality_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flags = d.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("n_chars") <= 2000).alias("short"), (F.col("toxic") == 0).alias("cross_check_ok"), F.lit(None).cast("string").alias("error"))
    return flags.where(corpus.verified(["good", "short"])).select("doc_id")


@_query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('7' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= round_even(n * 10 / 100, 0)")
def docs_percent_sample(spark, sf_dir):
    return corpus.percent_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10, "7")


_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_ROWS = f"list_filter(string_split_regex(text, '{_ENDS}'), lambda x, i: x <> '' OR i < len(string_split_regex(text, '{_ENDS}')))"


@_query(f"SELECT doc_id, len({_ROWS}) <= 40 AND coalesce(list_max(list_transform({_ROWS}, lambda x: length(x))), 0) <= 200 AS length_ok FROM documents")
def docs_length_check(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.length_ok("text").alias("length_ok"))


@_query("SELECT source, count(*) AS n, count(DISTINCT text) AS n_texts, sum(n_chars)::BIGINT AS chars, avg(n_chars) AS mean_chars FROM documents GROUP BY source")
def docs_totals(spark, sf_dir):
    g = table(spark, sf_dir, "documents").select("source", "n_chars", F.sha2("text", 256).alias("h")).groupBy("source")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("n_texts"), F.sum("n_chars").alias("chars"), F.avg("n_chars").alias("mean_chars"))


@_query(
    """WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM w WHERE length(word) > 1 GROUP BY word),
p AS (SELECT n, unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) AS pair FROM c)
SELECT pair, sum(n)::BIGINT AS n FROM p GROUP BY pair"""
)
def bpe_pair_counts(spark, sf_dir):
    return corpus.pair_counts(table(spark, sf_dir, "documents"), "text")


@_query(
    """WITH t AS (SELECT *, array_slice(['a', 'b', 'c', 'd', 'e', 'f', 'g'], 1, 7) AS s, (('0x' || sha256(doc_id::VARCHAR)[1:8])::BIGINT % 7)::INTEGER AS o FROM documents)
SELECT doc_id, array_to_string((s[o + 1:] || s[1:o])[1:3], ',') AS chosen FROM t"""
)
def rotation_select(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"), F.array(*map(F.lit, "abcdefg")).alias("s"))
    return d.select("doc_id", F.array_join(corpus.rotated("s", "h", 3), ",").alias("chosen"))


# --- conversations: pairing, templates, masks -----------------------------------------------------


@_query("SELECT conv_id, turn, text AS said, nxt AS answer FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user' AND nr = 'assistant'")
def conv_pairs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, sf_dir, "conversations").withColumns({"answer": F.lead("text").over(w), "nr": F.lead("role").over(w)})
    return c.where("role = 'user' AND nr = 'assistant'").select("conv_id", "turn", F.col("text").alias("said"), "answer")


@_query("SELECT conv_id, turn, sha256('<|' || role || '|>' || chr(10) || text || CASE WHEN text LIKE '%' || chr(10) THEN '' ELSE chr(10) END || '<|eos|>') AS h FROM conversations")
def conv_text_template(spark, sf_dir):
    end = F.when(F.col("text").endswith("\n"), "").otherwise("\n")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", end, F.lit("<|eos|>")), 256).alias("h"))


_TURNS = "t AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS said FROM conversations GROUP BY conv_id)"


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", F.transform("t", lambda x: x["role"]).alias("said"))


@_query(f"WITH {_TURNS} SELECT conv_id, array_to_string(list_transform(range(0, 12), lambda i: said[i % len(said) + 1]), ',') AS padded FROM t")
def cyclic_padding(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", F.array_join(corpus.padded("said", F.lit(12)), ",").alias("padded"))


_IDS = "i AS (SELECT conv_id, turn, role, text, list_transform(string_split(role || ' ' || text, ''), lambda c: ord(c)) AS ids FROM conversations)"


def _ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    chars = F.split(F.concat("role", F.lit(" "), "text"), "")
    return c.select("conv_id", "turn", "role", "text", F.transform(chars, F.ascii).alias("ids"))


@_query(f"WITH {_IDS} SELECT conv_id, turn, sha256(array_to_string(list_transform(ids, lambda x, p: CASE WHEN p > list_position(ids, 32) THEN x ELSE -100 END), ',')) AS h FROM i")
def loss_mask(spark, sf_dir):
    return _ids(spark, sf_dir).select("conv_id", "turn", F.sha2(F.array_join(corpus.loss_labels("ids", 32), ","), 256).alias("h"))


@_query(f"WITH {_IDS} SELECT conv_id, turn, sha256(array_to_string(list_resize(ids, max(len(ids)) OVER (PARTITION BY conv_id), 0), ',')) AS h FROM i")
def pad_batch(spark, sf_dir):
    """A conversation is a batch: its turns are padded to the longest of them."""
    ids = _ids(spark, sf_dir).select("conv_id", "turn", "ids")
    longest = ids.groupBy("conv_id").agg(F.max(F.size("ids")).alias("n"))
    return ids.join(longest, "conv_id").select("conv_id", "turn", F.sha2(F.array_join(corpus.right_padded("ids", F.col("n"), 0), ","), 256).alias("h"))


# --- events as attempts ---------------------------------------------------------------------------


@_query(
    """WITH t AS (SELECT user_id % 5 AS grp, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
e AS (SELECT grp, user_id, max(CASE WHEN n = 1 AND event_type = 'purchase' THEN 1 ELSE 0 END) AS one, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS k FROM t WHERE n <= 5 GROUP BY 1, 2)
SELECT grp, count(*) AS problems, avg(one) AS pass_at_1, avg(k) AS pass_at_k FROM e GROUP BY grp"""
)
def events_pass_at_k(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 5)
    return corpus.pass_rates(e, "grp", "user_id", "event_id", F.col("event_type") == "purchase", 5)


@_query("SELECT user_id % 5 AS grp, avg((event_type = 'purchase')::INT) AS purchase, avg(coalesce((value > 50)::INT, 0)) AS large FROM events GROUP BY 1")
def events_funnel_ratios(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return e.groupBy((F.col("user_id") % 5).alias("grp")).agg(rate(F.col("event_type") == "purchase").alias("purchase"), rate(F.col("value") > 50).alias("large"))


@_query(
    """SELECT range AS step, round(CASE WHEN range < 20 THEN 0.001 * (range + 1) / 20
 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(3.141592653589793 * least((range - 20) / 180, 1.0))) END, 12) AS lr FROM range(0, 220)"""
)
def lr_schedule(spark, sf_dir):
    d = corpus.lr_schedule(spark.range(220).withColumnRenamed("id", "step"), "step", 200, 20, 0.001, 0.1)
    return d.select("step", F.round("lr", 12).alias("lr"))


@_query("SELECT coalesce(n.n_nationkey, r.r_regionkey) AS key, coalesce(n.n_name, r.r_name) AS name FROM region r FULL JOIN nation n ON n.n_nationkey = r.r_regionkey")
def dictionary_merge(spark, sf_dir):
    old = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return corpus.merge(old, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), "key", "name")


@_query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def orders_last_wins(spark, sf_dir):
    return corpus.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


#: Sources and the stages that they pass: length, syntax, safety with signature.
_SOURCES = [
    ("def solve(xs, k):\n    return sorted(x for x in xs if x > k)\n", 3), ("def solve(xs, k):\n    return [pow(x, 2) + divmod(x, k)[0] for x in xs]\n", 3),
    ("import os\ndef solve(xs, k):\n    return xs\n", 2), ("def solve(xs):\n    return xs\n", 2), ("def solve(xs, k):\n    return xs.__class__\n", 2), ("def solve(xs, k:\n", 1),
    ("def solve(xs, k):\n    return [str(x) for x in xs]\n", 2), ("def solve(xs, k):\n    assert k\n    return xs\n", 2), ("def solve(xs, k):\n    return xs[0](k)\n", 2),
    ("def solve(xs, k):\n    return solve(xs, k)\n", 2), ("x = 1\ndef solve(xs, k):\n    return xs\n", 2), ("def solve(xs, k):\n" + "    k = k\n" * 40 + "    return xs\n", 0),
]


@_query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {n > 0}, {n > 1}, {n > 2}, {n > 2})" for i, (_, n) in enumerate(_SOURCES)) + ") t(i, length_ok, syntax_ok, ast_safe, signature_valid)")
def code_checks(spark, sf_dir):
    return verify.checked(spark.createDataFrame([(i, c) for i, (c, _) in enumerate(_SOURCES)], "i int, code string")).drop("code")


@_query(f"WITH {_SPACE} SELECT num_ops, count(*) AS codes, count(*) AS passed FROM h GROUP BY num_ops")
def code_verification(spark, sf_dir):
    """One source of each program, run on the program's boundary suite: the interpreter has to agree on all."""
    p = space.programs(spark).repartition("pos")
    tests = cases.tests(cases.boundary_suite(p.select("semantic_hash", "tags", "categories")))
    codes = render.variants(p, 1).join(tests, "semantic_hash").join(p.select("semantic_hash", "num_ops"), "semantic_hash")
    codes = codes.repartition(spark.sparkContext.defaultParallelism, "semantic_hash")  # small rows, long work
    done = verify.verified(codes).groupBy("num_ops")
    return done.agg(F.count(F.lit(1)).alias("codes"), F.count(F.when(verify.ok(), 1)).alias("passed"))


@_query(f"WITH {_SPACE} SELECT num_ops, count(*) AS n, 1.0::DOUBLE AS executable, 1.0::DOUBLE AS tests_passed FROM h WHERE pos % 7 = 0 GROUP BY num_ops")
def code_cross_check(spark, sf_dir):
    """A seventh of the programs in a style of theirs, against the interpreter on 32 fresh random inputs."""
    p = space.programs(spark).where("pos % 7 = 0").repartition("pos")
    tests = cases.tests(cases.suite(p.select("semantic_hash", "tags"), 32, 7))
    codes = render.variants(p, 1).join(tests, "semantic_hash").join(p.select("semantic_hash", "num_ops"), "semantic_hash")
    return corpus.funnel(verify.verified(codes), "num_ops", ["executable", "tests_passed"])


@_query(
    """WITH e AS (SELECT r_name AS key, n_nationkey AS idx FROM nation JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY sha256('0:' || key || ':' || idx::VARCHAR), idx) AS r FROM e)
SELECT key, idx, CASE WHEN n < 2 OR key LIKE 'frame:%' THEN 'shared' WHEN r <= least(greatest(1, round_even(n * 0.25, 0)), n - 1) THEN 'reserved' ELSE 'train' END AS pool FROM w"""
)
def template_pools(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("key"))
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("idx"))
    return dictionary.pools(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("key", "idx"), "0")


# --- programs as source code ------------------------------------------------------------------------

_FITS = "CASE WHEN list_has_any(categories, ['filter', 'map']) THEN 60 ELSE 52 END + CASE WHEN list_contains(tags, 'order:reverse') THEN 2 ELSE 0 END"


@_query(f"WITH {_SPACE} SELECT ({_FITS})::BIGINT AS n_styles, count(*) AS n FROM h GROUP BY 1")
def style_gate_counts(spark, sf_dir):
    p = space.programs(spark).select(F.size(render.applicable()).cast("long").alias("n_styles"))
    return p.groupBy("n_styles").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "WITH " + _SPACE + ", s(code_style, needs) AS (VALUES " + ", ".join(f"('{s.name}', {list(s.needs)}::VARCHAR[])" for s in render.STYLES) + """)
SELECT code_style, count(*) AS n FROM s JOIN h ON len(needs) = 0 OR list_has_any(tags || categories, needs) GROUP BY 1"""
)
def style_usage_counts(spark, sf_dir):
    p = space.programs(spark).select(F.explode(render.applicable()).alias("at"))
    name = F.element_at(F.array(*[F.lit(s.name) for s in render.STYLES]), F.col("at") + 1)
    return p.groupBy("at").agg(F.count(F.lit(1)).alias("n")).select(name.alias("code_style"), "n")


@_query()
def code_variants(spark, sf_dir):
    """Every program in every style: how many sources, how many distinct, and their largest extent."""
    v = render.variants(space.programs(spark).repartition("pos"))
    lines = F.split("code", "\n")  # the last is empty: a source ends with a line break
    sized = v.select("pos", "code_sha256", (F.size(lines) - 1).alias("rows"), F.array_max(F.transform(lines, F.length)).alias("width"))
    return sized.groupBy("pos").agg(F.count(F.lit(1)).alias("n_codes"), F.count_distinct("code_sha256").alias("n_distinct"), F.max("rows").alias("max_lines"), F.max("width").alias("max_chars"))


# --- programs told in Japanese, and the dictionary --------------------------------------------------

_PAIR = lambda e: (e, e) if isinstance(e, str) else e
_WORDS = "words(key, idx, terminal, te, size) AS (VALUES " + ", ".join(f"('{k}', {i}, '{_PAIR(e)[0]}', '{_PAIR(e)[1]}', {len(v)})" for k, v in instructions.OWN.items() for i, e in enumerate(v)) + ")"
_GLUE = lambda name: "[" + ", ".join(f"'{x}'" for x in instructions.GLUE[name]) + f"][1 + draw(semantic_hash, '{name}') % {len(instructions.GLUE[name])}]"
_TOLD = (
    f"{_SPACE}, {_WORDS}, "
    """o AS (SELECT semantic_hash, num_ops, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS i FROM h),
e AS (SELECT o.*, string_split(tag, ':') AS p, array_to_string(string_split(tag, ':')[1:2], ':') AS key FROM o),
u AS (SELECT e.semantic_hash, e.num_ops, e.i, e.p[1] AS cat, replace(coalesce(replace(f.terminal, '{frag}', w.terminal), w.terminal), 'N', coalesce(p[3], 'N')) AS terminal, replace(coalesce(replace(f.te, '{frag}', w.te), w.te), 'N', coalesce(p[3], 'N')) AS te
  FROM e JOIN words w ON w.key = e.key AND w.idx = draw(semantic_hash, 'op' || i::VARCHAR) % w.size
  LEFT JOIN words f ON e.p[1] = 'filter' AND f.key = 'frame:filter_verb' AND f.idx = draw(semantic_hash, 'frame' || i::VARCHAR) % f.size),
x AS (SELECT *, i = num_ops - 1 AS fin, lead(cat) OVER (PARTITION BY semantic_hash ORDER BY i) AS nxt FROM u),
g AS (SELECT semantic_hash, any_value(num_ops) AS num_ops, max(terminal) FILTER (WHERE fin) AS final,
  string_agg(CASE WHEN fin THEN terminal WHEN nxt = cat AND cat IN ('map', 'slice') THEN te || 'から' ELSE te || '、' END, '' ORDER BY i) AS seq,
  string_agg(CASE WHEN i = 0 THEN """ + _GLUE("first") + " WHEN fin THEN " + _GLUE("last") + " ELSE " + _GLUE("middle") + """ END || CASE WHEN fin THEN terminal ELSE te END, '、' ORDER BY i) AS ord,
  string_agg('(' || (i + 1)::VARCHAR || ') ' || terminal || '。', '' ORDER BY i) AS num,
  string_agg(CASE WHEN i = 0 THEN """ + _GLUE("first") + " WHEN fin THEN " + _GLUE("last") + " ELSE " + _GLUE("middle") + """ END || '、' || terminal || '。', '' ORDER BY i) AS wrd,
  string_agg(CASE WHEN i = num_ops - 2 THEN terminal ELSE te END, '、' ORDER BY i) FILTER (WHERE NOT fin) AS earlier FROM x GROUP BY semantic_hash),
k AS (SELECT g.*, rtrim(a.terminal, '、') || '、' AS op, b.terminal AS cl, CASE WHEN num_ops > 1 THEN draw(semantic_hash, 'template') % 4 ELSE 0 END AS t FROM g
  JOIN words a ON a.key = 'frame:opening' AND a.idx = draw(semantic_hash, 'opening') % a.size JOIN words b ON b.key = 'frame:closing' AND b.idx = draw(semantic_hash, 'closing') % b.size)
SELECT semantic_hash, CASE t WHEN 0 THEN op || seq || cl WHEN 1 THEN op || ord || cl WHEN 2 THEN op || """ + _GLUE("lead") + " || cl || CASE WHEN " + _GLUE("style") + """ = 'numbers' THEN num ELSE wrd END
  ELSE op || final || cl || """ + _GLUE("goal_lead") + " || final || '前に、' || earlier || " + _GLUE("goal_tail") + " END AS text FROM k"
)
_DRAW = re.compile(r"draw\(semantic_hash, ((?:'[^']*'|i::VARCHAR|\s\|\|\s)+)\)")


@_query("WITH " + _DRAW.sub(lambda m: f"('0x' || sha256(semantic_hash || ':0:0:' || {m[1]})[1:8])::BIGINT", _TOLD))
def instructions_told(spark, sf_dir):
    return instructions.told(instructions.chosen(space.programs(spark).select("semantic_hash", "tags"))).select("semantic_hash", "text")


@_query(f"WITH {_SPACE} SELECT count(*) * 3 AS sentences, count(*) * 3 AS distinct_sentences, 0::BIGINT AS faults FROM h WHERE pos % 5 = 0")
def instructions_replayed(spark, sf_dir):
    """Three different sentences of a fifth of the programs, told again from their choices."""
    p = space.programs(spark).where("pos % 5 = 0").select("semantic_hash", "tags")
    own = dictionary.content_sha256(dictionary.from_expressions(instructions.OWN))
    r = instructions.renderings(p, 3).withColumn("dictionary_sha256", F.lit(own))
    n = r.agg(F.count(F.lit(1)).alias("sentences"), F.count_distinct("semantic_hash", "text").alias("distinct_sentences"))
    return n.crossJoin(instructions.replay_faults(r, p, instructions.OWN, own).agg(F.count(F.lit(1)).alias("faults")))  # one row each


#: A dictionary with a fault of each kind, and the faults.
_FAULTY = {
    "filter:even": {"slot_type": "ADNOMINAL", "expressions": ["偶数の", "偶数の値", "偶数を", "偶数だけの", " "]}, "filter:odd": {"slot_type": "TEXT", "expressions": []}, "nope": {"slot_type": None, "expressions": ["x"]},
    "map:add_k": {"slot_type": "ACTION_PAIR", "expressions": [{"terminal": "kを足す", "te": "kを足してから"}, {"terminal": "kを足して", "te": "kを足し"}, {"terminal": "足す操作", "te": "足して"}, {"terminal": "足す", "te": "足す"}, "kを足す"]},
    "frame:filter_verb": {"slot_type": "ACTION_PAIR", "expressions": [{"terminal": "要素を残す", "te": "{frag}要素を残して"}, {"terminal": "正の{frag}要素を残す", "te": "{frag}要素を残して"}]},
    "frame:opening": {"slot_type": "TEXT", "expressions": ["リストxsから、", "始めます。"]}, "frame:closing": {"slot_type": "TEXT", "expressions": ["関数を書く"]},
}
_FAULTS = [
    ("filter:even", 4, "empty text"), ("filter:odd", None, "slot type"), ("filter:odd", None, "no expressions"), ("nope", 0, "unknown key"), ("map:add_k", 4, "missing form"), ("frame:filter_verb", 0, "one placeholder"),
    ("filter:even", 1, "ends in a noun"), ("filter:even", 2, "ends in a particle"), ("filter:even", 3, "narrows twice"), ("map:add_k", 0, "te has the connective"), ("map:add_k", 1, "terminal is a te form"), ("map:add_k", 1, "te is no te form"),
    ("map:add_k", 2, "terminal ends in a noun"), ("map:add_k", 3, "te equals terminal"), ("map:add_k", 3, "te is no te form"), ("frame:filter_verb", 1, "text before the placeholder"),
    ("frame:opening", 0, "opening takes from the list"), ("frame:opening", 1, "opening ends the sentence"), ("frame:closing", 0, "closing does not end the sentence"), ("frame:closing", 0, "closing does not name solve"),
]


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {-1 if i is None else i}, '{r}')" for k, i, r in _FAULTS) + ") t(key, idx, rule)")
def dictionary_faults(spark, sf_dir):
    t = dictionary.table(spark, _FAULTY)
    both = dictionary.structure_faults(t).unionByName(dictionary.contract_faults(t))
    return both.withColumn("idx", F.coalesce("idx", F.lit(-1)))


@_query(f"WITH {_SPACE}, c AS (SELECT ({_FITS})::BIGINT AS n, label FROM h WHERE num_ops < 3) SELECT label, count(*) AS records, sum(n)::BIGINT AS codes, (count(*) * 4)::BIGINT AS said FROM c GROUP BY label")
def corpus_records(spark, sf_dir):
    """Programs of one and two operations joined with their sentences and sources on spec_id."""
    p = space.programs(spark).where("num_ops < 3").withColumns({"spec_id": F.concat(F.lit("s"), F.lpad(F.col("pos").cast("string"), 6, "0")), "label": F.array_join("categories", ">")})
    ids = p.select("spec_id", "semantic_hash")
    said = instructions.told(instructions.chosen(p.select("semantic_hash", "tags"), attempts=4)).groupBy("semantic_hash").agg(F.collect_list("text").alias("value"))
    said = said.join(ids, "semantic_hash").select("spec_id", "semantic_hash", "value", F.lit(0).alias("pos"))
    codes = render.variants(p).groupBy("semantic_hash").agg(F.collect_list("code").alias("value")).join(ids, "semantic_hash").select("spec_id", "semantic_hash", "value", F.lit(0).alias("pos"))
    joined = corpus.corpus_join(p.select("spec_id", "semantic_hash", "label"), said, codes)
    own = joined.withColumn("heads", F.size(F.slice("instructions", 1, 4)))
    return own.groupBy("label").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("codes")).alias("codes"), F.sum("heads").alias("said"))


@_query("SELECT doc_id, floor((row_number() OVER (ORDER BY sha256('0:2:' || doc_id::VARCHAR), doc_id) - 1) / 64)::BIGINT AS batch FROM documents")
def docs_epoch_batches(spark, sf_dir):
    return corpus.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64, 2)


@_query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('3' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 50")
def docs_sample_of_n(spark, sf_dir):
    return corpus.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, "3")


@_query("SELECT conv_id, turn, sha256('<|task|>' || chr(10) || role || chr(10) || '<|code|>' || chr(10) || text || CASE WHEN text LIKE '%' || chr(10) THEN '' ELSE chr(10) END || '<|eos|>') AS h, sha256(role || chr(10) || chr(10) || text) AS prompt FROM conversations")
def conv_records(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.sha2(corpus.record_text("role", "text"), 256).alias("h"), corpus.text_sha256("role", "text").alias("prompt"))


@_query(f"WITH {_IDS} SELECT conv_id, turn FROM i WHERE len(ids) <= 200 AND list_contains(ids, 32)")
def conv_fits_model(spark, sf_dir):
    return _ids(spark, sf_dir).where(corpus.fits_model("ids", 200, 32)).select("conv_id", "turn")


@_query("SELECT event_type, sum(value * user_id) / greatest(sum(user_id), 1) AS loss FROM events GROUP BY 1")
def events_weighted_loss(spark, sf_dir):
    return corpus.weighted_loss(table(spark, sf_dir, "events"), "event_type", "value", "user_id").select("event_type", "loss")


@_query("SELECT split_part(c_name, '#', 1) AS key, count(*) AS n FROM customer GROUP BY 1")
def names_most_common(spark, sf_dir):
    return corpus.most_common(table(spark, sf_dir, "customer").select(F.replace("c_name", F.lit("#"), F.lit("[")).alias("p")), "p")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
