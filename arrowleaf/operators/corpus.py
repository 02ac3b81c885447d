"""Joins, pairing, sampling, filters, metrics, and token layouts of the dataset pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The last row of each key by position."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), pos).alias("r")).select("r.*")


def merge(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer merge: the newer value wins."""
    o, n = old.select(key, F.col(value).alias("_o")), new.select(key, F.col(value).alias("_n"))
    return o.join(n, key, "full").select(key, F.coalesce("_n", "_o").alias(value))


def corpus_join(asts: DataFrame, instructions: DataFrame, codes: DataFrame) -> DataFrame:
    """Records on spec_id; a missing partner, unequal hashes or unfit list lengths raise.

    ``instructions`` and ``codes`` have (spec_id, semantic_hash, value array<string>, pos).
    """
    i = last_wins(instructions, "spec_id", "pos").select("spec_id", F.col("semantic_hash").alias("hi"), F.col("value").alias("said"))
    c = last_wins(codes, "spec_id", "pos").select("spec_id", F.col("semantic_hash").alias("hc"), F.col("value").alias("codes"))
    j = asts.join(i, "spec_id", "left").join(c, "spec_id", "left")
    ok = F.col("hi").eqNullSafe(F.col("semantic_hash")) & F.col("hc").eqNullSafe(F.col("semantic_hash")) & (F.size("codes") >= 1) & F.size("said").between(1, F.size("codes"))
    checked = F.when(ok, F.col("codes")).otherwise(F.raise_error(F.concat(F.lit("no fit for "), "spec_id")).cast("array<string>"))
    return j.select(*asts.columns, checked.alias("codes"), padded("said", F.size("codes")).alias("instructions"))


def padded(items: str, n: Column) -> Column:
    """The list repeated from its start to n items."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(items, (i % F.size(items) + 1).cast("int")))


def pairs(df: DataFrame, left: str, right: str, *keep: str) -> DataFrame:
    """Strict pairwise explode: lists of unequal length raise."""
    ok = F.when(F.size(left) == F.size(right), F.arrays_zip(F.col(left).alias("left"), F.col(right).alias("right"))).otherwise(F.raise_error(F.lit("lists of unequal length")))
    return df.select(*keep, F.posexplode(ok).alias("at", "p")).select(*keep, "at", F.col("p.left").alias("left"), F.col("p.right").alias("right"))


def percent_sample(df: DataFrame, key: str, percent: float, seed: str) -> DataFrame:
    """Exactly round(n p / 100) rows, half to even, in the order of a seeded hash."""
    if not 0 <= percent <= 100:
        raise ValueError("percent is from 0 to 100")
    return sample(df, key, round(df.count() * percent / 100), seed)


def sample(df: DataFrame, key: str, n: int, seed: str, buckets: int = 4096) -> DataFrame:
    """The n rows of the smallest seeded hashes, ties by key; all rows when there are no more than n.

    Rows are counted by the hash's first digits; whole buckets below the cut are taken by a filter and
    only the bucket that the cut falls in is sorted, so no task holds the sample.
    """
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    first = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    d = df.withColumn("_h", h).withColumn("_b", F.shiftright(first * buckets, 32).cast("int"))
    left, cut = n, buckets
    for r in d.groupBy("_b").count().orderBy("_b").collect():  # at most ``buckets`` rows
        if left < r["count"]:
            cut = r["_b"]
            break
        left -= r["count"]
    whole = d.where(F.col("_b") < cut)
    if cut < buckets and left > 0:
        whole = whole.unionByName(d.where(F.col("_b") == cut).orderBy("_h", key).limit(left))
    return whole.drop("_h", "_b")


def rotated(items: str, semantic_hash: str, n: int | None) -> Column:
    """The first n items of the list rotated by the hash; all when n is None or too large, none when n <= 0."""
    size = F.size(items)
    off = (F.conv(F.substring(semantic_hash, 1, 8), 16, 10).cast("long") % size).cast("int")
    turned = F.concat(F.slice(items, off + 1, size), F.slice(items, F.lit(1), off))
    if n is None:
        return turned
    return F.slice(turned, F.lit(1), F.lit(max(n, 0)))


def verified(flags: list[str], error: str = "error", cross: str = "cross_check_ok") -> Column:
    """All flags true and no error; a missing cross-check passes, a missing flag does not."""
    out = F.col(error).isNull() & F.coalesce(F.col(cross), F.lit(True))
    for f in flags:
        out = out & F.coalesce(F.col(f), F.lit(False))
    return out


#: What ends a line, as Python's splitlines has it.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def text_lines(text: str) -> Column:
    """The lines of a text; a final line end starts no further line."""
    parts = F.split(F.col(text), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_extent(text: str) -> tuple[Column, Column]:
    """The number of lines and the length of the longest."""
    rows = text_lines(text)
    return F.size(rows), F.coalesce(F.array_max(F.transform(rows, F.length)), F.lit(0))


def length_ok(text: str, lines: int = 40, chars: int = 200) -> Column:
    n, longest = line_extent(text)
    return (n <= lines) & (longest <= chars)


def pass_rates(tries: DataFrame, group: str, problem: str, order: str, passed: Column, k: int) -> DataFrame:
    """pass@1 (the first try) and pass@k (any of the first k), as means over problems."""
    w = W.partitionBy(group, problem).orderBy(order)
    t = tries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).withColumn("_p", F.coalesce(passed, F.lit(False)).cast("int"))
    each = t.groupBy(group, problem).agg(F.max(F.when(F.col("_n") == 1, F.col("_p")).otherwise(0)).alias("one"), F.max("_p").alias("any"))
    return each.groupBy(group).agg(F.count(F.lit(1)).alias("problems"), F.avg("one").alias("pass_at_1"), F.avg("any").alias("pass_at_k"))


def loss_labels(ids: str, mark: int, ignore: int = -100) -> Column:
    """Labels: all up to and including the mark are ignored."""
    at = F.array_position(ids, mark)
    return F.transform(ids, lambda x, i: F.when(i + 1 > at, x).otherwise(ignore))


def right_padded(ids: str, width: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), (width - F.size(ids)).cast("int")))


def lr_schedule(df: DataFrame, step: str, total: int, warm: int, top: float, low: float) -> DataFrame:
    """Linear warm-up, then a cosine to ``top * low``."""
    s = F.col(step)
    part = (s - warm) / F.lit(max(total - warm, 1))
    cosine = F.lit(top * low) + F.lit(top - top * low) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(part, F.lit(1.0))))
    return df.withColumn("lr", F.when(s < warm, F.lit(top) * (s + 1) / F.lit(max(warm, 1))).otherwise(cosine))


def pair_counts(df: DataFrame, text: str) -> DataFrame:
    """(pair, n): adjacent character pairs inside words, weighted by word counts: one step of pair merging."""
    words = df.select(F.explode(F.split(F.lower(text), "[ \n]+")).alias("word")).where("word <> ''").groupBy("word").count()
    at = F.sequence(F.lit(1), F.length("word") - 1)
    p = words.where(F.length("word") > 1).select("count", F.explode(F.transform(at, lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    return p.groupBy("pair").agg(F.sum("count").alias("n"))


def record_text(said: str, code: str) -> Column:
    """A training record of one instruction and one source; a final line end is added where it lacks."""
    end = F.when(F.col(code).endswith("\n"), "").otherwise("\n")
    return F.concat(F.lit("<|task|>\n"), said, F.lit("\n<|code|>\n"), code, end, F.lit("<|eos|>"))


def text_sha256(system: str, user: str) -> Column:
    """The digest of a prompt of two parts."""
    return F.sha2(F.concat(F.col(system), F.lit("\n\n"), F.col(user)), 256)


def fits_model(ids: str, most: int, mark: int) -> Column:
    """Whether a record's ids are few enough and hold the mark."""
    return (F.size(ids) <= most) & F.array_contains(ids, mark)


def id_width(vocabulary: int) -> int:
    """Bytes of an id; ids have to fit 16 bits."""
    if vocabulary > 65_535:
        raise ValueError("an id has 16 bits")
    return 2


def zipped(left: DataFrame, right: DataFrame, pos: str) -> DataFrame:
    """The i-th row of one table beside the i-th of the other; tables of unequal length raise."""
    w = W.orderBy(pos)
    l, r = (d.withColumn("_i", F.row_number().over(w)).drop(pos) for d in (left, right))
    both = l.join(r.withColumnRenamed("_i", "_j"), F.col("_i") == F.col("_j"), "full")
    ok = F.when(F.col("_i").isNotNull() & F.col("_j").isNotNull(), F.col("_i") - 1).otherwise(F.raise_error(F.lit("tables of unequal length")).cast("int"))
    return both.withColumn("at", ok).drop("_i", "_j")


def grouped_lists(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, n, first, values): the values of each key in order, with the position where the key first occurs."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).alias("l"))
    return g.select(key, F.size("l").alias("n"), F.get("l", F.lit(0))["p"].alias("first"), F.transform("l", lambda x: x["v"]).alias("values"))


def first_seen(df: DataFrame, key: Column, name: str, pos: str, value: str) -> DataFrame:
    """(name, value): for each key, the value of the row where it first occurs."""
    return df.groupBy(key.alias(name)).agg(F.min_by(value, pos).alias(value))


def most_common(df: DataFrame, problem: str) -> DataFrame:
    """(key, n) of problems by what stands before the bracket, most frequent first."""
    return df.groupBy(F.substring_index(problem, "[", 1).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def weighted_loss(df: DataFrame, group: str, loss: str, tokens: str) -> DataFrame:
    """The mean loss a token of each group."""
    return df.groupBy(group).agg((F.sum(F.col(loss) * F.col(tokens)) / F.greatest(F.sum(tokens), F.lit(1))).alias("loss"))


def sweep(df: DataFrame, keys: str, pos: str) -> DataFrame:
    """The rows that bring a key that no row before them had: those where some key is first seen."""
    first = df.select(pos, F.explode(keys).alias("_k")).groupBy("_k").agg(F.min(pos).alias(pos)).select(pos).distinct()
    return df.join(first, pos, "left_semi")


def batches(df: DataFrame, key: str, size: int, epoch: int = 0, seed: str = "0") -> DataFrame:
    """``df`` with ``batch``: rows in the order of a hash of seed, epoch and key, ``size`` a batch.

    Places come from counts a bucket and ranks inside buckets, so no task orders the whole table.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")), 256)
    d = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    before = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before"))  # at most 4096 rows
    d = d.join(F.broadcast(before), "_b").withColumn("_at", F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) - 1)
    return d.withColumn("batch", F.floor(F.col("_at") / size)).drop("_h", "_b", "_before", "_at")


def steps_of(tokens_a_batch: int, budget: int) -> int:
    """Whole steps that a budget of tokens pays for, at least one."""
    return max(1, budget // max(1, tokens_a_batch))


def funnel(results: DataFrame, group: str, stages: list[str]) -> DataFrame:
    """The share of rows of each group that pass each stage."""
    return results.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(F.col(s), F.lit(False)).cast("int")).alias(s) for s in stages])


def train_bpe(words: DataFrame, merges: int, most: int = 16) -> list[tuple[str, str]]:
    """The first merges of byte-level pair encoding over (word, n), each of the most frequent pair.

    Words are arrays of byte symbols in hexadecimal.  Ties go to the smaller pair; a pair that would be
    longer than ``most`` bytes is passed over.  Only the best pair comes to the driver; the word table
    is written anew every eight merges, so its lineage stays short.
    """
    hexed = F.hex(F.encode("word", "UTF-8"))
    symbols = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.substring(hexed, i, F.lit(2)))
    now = words.where("word <> ''").select(symbols.alias("s"), "n")
    done: list[tuple[str, str]] = []
    for step in range(merges):
        at = F.sequence(F.lit(0), F.size("s") - 2)
        pairs = now.where(F.size("s") > 1).select("n", F.explode(F.transform(at, lambda i: F.struct(F.get("s", i).alias("a"), F.get("s", i + 1).alias("b")))).alias("p"))
        best = pairs.where(F.length("p.a") + F.length("p.b") <= 2 * most).groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").first()
        if best is None:
            break
        a, b = best.p.a, best.p.b
        done.append((a, b))
        merge = f"aggregate(s, cast(array() as array<string>), (acc, x) -> IF(size(acc) > 0 AND element_at(acc, -1) = '{a}' AND x = '{b}', concat(slice(acc, 1, size(acc) - 1), array('{a}{b}')), concat(acc, array(x))))"
        now = now.select(F.expr(merge).alias("s"), "n")
        if step % 8 == 7:
            now = now.checkpoint() if now.sparkSession.sparkContext.getCheckpointDir() else now.persist()
    return done
