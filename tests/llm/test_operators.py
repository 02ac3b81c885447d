"""The corpus operators against brute force, on odd rows: nulls, empty and long texts, ties, repeats."""

import base64
import collections
import hashlib
import json
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arrowleaf.llm import bpe, decontaminate, katz, linededup, neardup, pages, quality, queries, simhash, tokenfiles, topk, toxicity
from arrowleaf.llm.common import skew_safe_semi, work_path

rnd = random.Random(11)
VOCAB = ["the", "of", "and", "Tower", "river", "to", "in", "blue", "12", "kg", "don't", "été", "straße", "漢字", "a"]


def sentence(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n)) + "."


COMMON = "This line is on every page"
TEXTS = [sentence(rnd.randint(1, 60)) + ("\n " + COMMON.upper() + "\t" if i % 2 else "") + "\nlast " + str(i) for i in range(40)]
TEXTS += [None, "", "   ", "\n\n", TEXTS[0], TEXTS[0] + " more", "x" * 5000, sentence(8000), "one", "One", "a\x0bb\x1cc d e"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, TEXTS[3]), (None, "lonely text"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names operators use inside
    return spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in ROWS], "doc_id long, text string, h string, row int, fp int, key string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def same(rows, want, *columns):
    got = collections.Counter(tuple(r[c] for c in columns) for r in rows)
    assert got == collections.Counter(want)


def test_bpe(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in ROWS:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(bpe.round_trip(docs, queries.codec()).collect(), want, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert bpe.round_trip(none, queries.codec()).count() == 0
    assert {r.doc_id: list(r.ids) for r in bpe.encode(docs, queries.codec()).collect()}[0] == enc.encode_ordinary(TEXTS[0])
    keys = list(ranks)
    assert sorted(queries.codec().hash.slots(keys).tolist()) == list(range(len(keys)))


def test_token_files(spark, docs, none):
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tok = Tokenizer.from_str(spec)
    path = work_path(spark, "t.orc")
    tokenfiles.write(docs, path, spec)
    got = sorted(tokenfiles.with_crc(tokenfiles.read(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    start, left = 0, collections.Counter()
    for i, t in ROWS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        left[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    for r in got:
        assert r.start == start
        start += r.n_tokens
        left[r.doc_id, r.n_tokens, r.ids_crc32] -= 1
    assert not any(left.values())
    tokenfiles.write(none, path + "0", spec)
    assert tokenfiles.read(spark, path + "0").count() == 0


def test_chunks_equal_the_library():
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tok, own = Tokenizer.from_str(spec), tokenfiles.Chunks(spec, limit=200)
    assert own.direct
    signs = "ab'sSZ \n\t\x0b\x1c\x85\xa0é漢0².,!🙂̸=<>|ſΣÅİßÿÉ_-"
    texts = ["".join(rnd.choice(signs) if rnd.random() < 0.95 else rnd.choice(["<|endoftext|>", "<|ENDOFTEXT|>"]) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    texts += [None, ""]
    for other in (spec, json.dumps({**json.loads(spec), "pre_tokenizer": {"type": "Whitespace"}})):  # the second is encoded text by text
        tok, own = Tokenizer.from_str(other), tokenfiles.Chunks(other, limit=200)
        assert own.direct == (other is spec)
        for at in range(0, len(texts), 7):
            ids, ends = own.encode(pa.array(texts[at : at + 7], pa.string()))
            for t, a, z in zip(texts[at : at + 7], ends, ends[1:], strict=False):
                assert ids[a:z].tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_token_files_are_pruned(spark):
    """Stripes read in parallel parts, integer run lengths, and scans that skip row groups by range and Bloom filter."""
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    path = work_path(spark, "pruned.orc")
    d = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text"))
    tokenfiles.write(d, path, spec)

    def scanned(where):
        q = spark.read.orc(path).where(where).select("n_tokens")
        rows = q.collect()
        plan = q._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return len(rows), leaf.metrics().get("numOutputRows").get().value(), plan.toString()

    n, read, plan = scanned("doc_id = 20000")
    assert n == 1 and 0 < read <= 2000 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,20000)]" in plan
    assert scanned("doc_id = 20001")[:2] == (0, 0)  # inside the range of a row group: the Bloom filter tells
    files = [f for f in os.listdir(path) if f.endswith(".orc")]
    assert len(files) > 1
    total = 0
    for f in files:
        whole = orc.ORCFile(os.path.join(path, f))
        total += sum(whole.read_stripe(i, ["doc_id"]).num_rows for i in range(whole.nstripes))
        ids = whole.read(["ids"]).column(0).combine_chunks().flatten()
        assert os.path.getsize(os.path.join(path, f)) < ids.nbytes / 4  # equal runs take little room
    assert total == 20_000


def test_line_dedup(docs, none):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    where = collections.defaultdict(set)
    for i, t in ROWS:
        for line in (t or "").split("\n"):
            where[key(line)].add(i)
    want, texts = [], []
    for i, t in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(where[key(x)]) < 10]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        texts.append((i, "\n".join(kept) or None if t is None else "\n".join(kept)))
    same(linededup.line_report(docs).collect(), want, "doc_id", "n_lines", "n_dropped", "kept_sha256")
    out = linededup.drop_lines(docs)
    assert out.columns == docs.columns
    same(out.collect(), texts, "doc_id", "text")
    assert linededup.line_report(none).count() == 0


def test_skew_safe_semi(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 9000, 0).otherwise(F.col("id") % 5000).alias("k"))
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 2 = 0")
    assert skew_safe_semi(rows, keys, ["k"], "n", 20_000).count() == rows.where("k % 2 = 0").count()


def _components(fps, radius=4):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if bin((a ^ fps[j]) & (1 << 64) - 1).count("1") <= radius:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def test_simhash(docs, none):
    fps = []
    for _, t in ROWS:
        w = [x for x in (t or "").encode().lower().split()]
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h)))
    comp = _components(fps)
    least = {}
    for (i, _), c in zip(ROWS, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [(i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(ROWS, fps, comp, strict=True)]
    same(simhash.near_groups(docs).collect(), want, "doc_id", "fingerprint", "component_id")
    assert simhash.one_of_each(docs).count() == len(set(comp))
    assert simhash.near_groups(none).count() == 0


def test_simhash_dense_group(spark):
    base, fps = rnd.getrandbits(64), set()
    for _ in range(400):  # chains and clusters round one value, in blocks of 50
        f = base
        for b in rnd.sample(range(20), rnd.randint(0, 6)):
            f ^= 1 << b
        fps.add(f)
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(d, 4, block=50)).collect()}
    want = _components(fps)
    by = collections.defaultdict(set)
    for f, c in zip(fps, want, strict=True):
        by[c].add(got.get(f, f))
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)
    cost, way = simhash.allocate([[0, 5, 9], [0, 1, 2], [0, 4, 5]], 3)
    assert (cost, way) == (6.0, [-1, 0, 1]) and sum(t + 1 for t in way) == 3


def test_column_names_and_empty_tables(spark, docs, none):
    """Stages keep columns of any name, and give no rows for none."""
    names = ["_h", "_gone", "_id", "_row", "_keep", "_hash", "_ID2", "a.b"]
    d = docs.select("doc_id", "text", *[F.lit(f"v{n}").alias(n) for n in names])
    bench = spark.createDataFrame([(1, TEXTS[5])], "item_id long, text string")
    for out in (linededup.drop_lines(d), simhash.one_of_each(d), neardup.one_of_each(d), decontaminate.clean(d, bench)):
        rows = out.collect()
        assert out.columns == d.columns and rows and all(r[f"{n}"] == f"v{n}" for r in rows for n in names)
    for out in (linededup.drop_lines(none), simhash.one_of_each(none), neardup.one_of_each(none), decontaminate.clean(none, bench)):
        assert out.count() == 0 and out.columns == none.columns


def test_insertions_and_number_runs(spark):
    item = "the train goes 5 km along the river in the valley and then it waits for about 5 hours"
    bench = spark.createDataFrame([(1, item)] + [(i, "now count " + " ".join(map(str, range(40)))) for i in range(2, 12)], "item_id long, text string")
    torn = item.replace("5 km", "7 km").replace("5 hours", "8 hours")
    rows = [(1, torn), (2, torn.replace("along", "very along")), (3, item.replace("5", "9")), (4, item.replace("5", "9").replace("along", "very along")), (5, " ".join(["12 34 56 78"] * 120))]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(3, 1), (4, 1)}


def test_decontamination(spark, docs, none):
    item = "A train leaves Paris at 9 and travels 120 km in 2 hours before it stops, how fast does it go on average"
    items = [(1, item), (2, "entirely other words that nobody wrote down so far anywhere at all"), (3, None), (4, ""), (5, "two words"), (6, item)]
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    other = item.replace("Paris", "London").replace("9", "7").replace("120", "300").replace("2 hours", "5 hours")
    mixed = "A train leaves Paris at 9 and travels 9 km in 9 hours before it stops, how fast does it go on average"
    held = [(100, "before. " + item + " after"), (101, other), (102, "some " + item[: len(item) // 3]), (103, item.upper()), (104, None), (105, ""), (106, "two words"), (107, "these are two words more"), (108, mixed)]
    more = spark.createDataFrame([(*r, "x", 1, 2, "k") for r in held], docs.schema)
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs.unionByName(more), bench).collect()}
    assert got[100, 1] == got[100, 6] == "exact" and got[101, 1] == "reparameterised" and got[106, 5] == "exact"
    assert {d for d, _ in got} <= {100, 101, 103, 106, 108}
    kept = decontaminate.clean(more, bench)
    assert kept.columns == docs.columns and {102, 104, 105, 107} <= {r.doc_id for r in kept.collect()}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, "take 5 apples and 5 pears then give 5 plums back to him")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "take 7 apples and 7 pears then give 7 plums back to him"), (2, "take 7 apples and 8 pears then give 9 plums back to him")], "doc_id long, text string")
    assert [(r.doc_id, r.kind) for r in decontaminate.leaks(docs, bench).collect()] == [(1, "reparameterised")]


def test_pages(spark):
    page = lambda body: f"<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div>{body}<footer>&copy; x</footer></body></html>"
    rows = [(i, "http://h.example/%d" % i, page(f"<article><h1>T{i} &amp; u</h1><p>first  line<br>of {i}<p>second {i % 3}<p>Like us<div class=box>Follow us on the site</div><script>no()</script><section id=comments>hi</section></article>")) for i in range(12)]
    rows += [(50, "http://q.example/", page("<div><p>plain page &nbsp; text</p><ul><li><a href=y>only link</a></li></ul></div>")), (51, None, None), (52, "x", ""), (53, "http://h.example/z", "<p>a<p>b</b></p><!-- c --><p>d"), (54, "u", "text < 5 & <b>bold</b>")]
    rows += [rows[0], rows[0], (60, "http://k.example/a", page("<main>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</main>"))]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, h int")
    got = pages.extract(d).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert text[3] == "T3 & u\nfirst line of 3\nsecond 0"  # the box recurs on the host, and so does a paragraph on all of its pages
    assert text[50] == "plain page text" and text[51] == text[52] == "" and text[53] == "a\nb\nd" and text[54] == "text < 5 & bold" and text[60] == "deep"
    assert pages.extract(d.limit(0)).count() == 0
    # templates that are too many to broadcast give the same
    same(pages.extract(d, broadcast=0).collect(), [tuple(r) for r in got], "page_id", "url", "text", "n_chars", "n_template")
    # copies of one article are no template
    copies = spark.createDataFrame([(i, "http://c.example/", page("<article><div><p>the same text</p></div></article>")) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in pages.extract(copies).collect()} == {"the same text"}


def test_page_markup():
    def article(body):
        return pages.text_blocks(pages.parse(f"<html><body><nav>n</nav><article>{body}</article></body></html>"))

    assert article('<p>see <a href="/the-hidden-door">the door</a></p>') == ["see the door"]
    assert article('<p title="a hidden gem">x</p><p data-hidden="false">y</p><p data-id="ad">z</p>') == ["x", "y", "z"]
    assert article('<table class="share-price"><tr><td>1</td></tr></table><section class="related-work">w</section><h2 id="related">r</h2>') == ["1", "w", "r"]
    assert article("a<svg/>b <svg><path/></svg>c <math><mi>q</mi></math>") == ["ab c q"]
    assert article('<p>k</p><div class="share-buttons">s</div><p class="ad">ad</p><section id=comments>c</section><div class="newsletterBox">n</div>') == ["k"]
    assert pages.text_blocks(pages.parse('<div class="social-page"><article><p>t</p></article></div>')) == ["t"]
    assert pages.text_blocks(pages.parse("<html><head><title>t</title><meta charset=x><body><article>hello</article>")) == ["hello"]
    assert pages.text_blocks(pages.parse("<head><title>t</title><p>hello")) == ["hello"]


def test_templates_do_the_work(spark):
    """Menus of other links on each page are one shape; an unmarked box on a fifth of a large host goes."""
    html = [
        f"<body><ul>{''.join(f'<li><a href=/{i}{j}>w{i} {j}</a>' for j in range(i % 3 + 2))}</ul><article><h1>T{i}</h1><p>text {i}</p>{'<div>Read our special pages</div>' * (i % 5 == 0)}</article>" for i in range(60)
    ]
    d = spark.createDataFrame([(i, "http://h.example/", x) for i, x in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.extract(d).collect()}
    assert all(r.n_template == i % 3 + 2 + (i % 5 == 0) and r.text == f"T{i}\ntext {i}" for i, r in got.items())


def test_topk(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)) * rng.uniform(0.1, 3, (300, 1))
    x[40:60] = x[0]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 14), (402, [float("nan")] * 16), (403, [1.0]), (None, [1.0] * 16), (404, [float("inf")] * 16)]
    d = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, score string")
    q = np.floor(64 * x).astype(np.int64)
    want = []
    for i in range(0, 300, 20):
        s = q @ q[i]
        for r, j in enumerate(sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:7]):
            want.append((i, r + 1, j, int(s[j])))
    same(topk.search(d, lambda i: i % 20 == 0, k=7, dims=6, group=4).collect(), want, "query_id", "rank", "vec_id", "score")
    assert topk.search(d.limit(0), lambda i: i % 20 == 0).count() == 0
    assert topk.search(d.where("vec_id < 4"), lambda i: i == 0, k=20).count() == 3


def test_katz(spark, docs, none):
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    c = collections.Counter()
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    for i, t in ROWS:
        if fold(i):
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    got = collections.defaultdict(list)
    for r in katz.train_and_score(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    for i, t in ROWS[:40]:
        w, r = words(t), got[i][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 0, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) and r.score < 0
    assert katz.train_and_score(none).count() == 0


def test_katz_sums_to_one(spark):
    train = spark.createDataFrame([(x,) for x in ["a b a b c", "a b d", "", "c a", "b b b a", "e f g a b", None] * 3 + ["z y x a"]], "text string")
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(["a b a b c", "q a zz b", "", None, "b b b a x a b"])], "doc_id int, text string")
    scores = []
    for room in (4_000_000, 5, 0):
        m, table = katz.fit(train, max_pairs=room)
        rest = table.toPandas()
        pairs = rest[rest.kind == katz.PAIR]
        assert len(m.pair) <= room and m.whole == (len(pairs) == 0)
        gain = {**dict(zip(m.pair.tolist(), m.pair_gain, strict=True)), **dict(zip(pairs.key, pairs.gain, strict=True))}
        ids = np.array([i for i in range(len(m.count)) if i != katz.BEGIN])
        for h in range(len(m.count)):
            if h != katz.END:
                p = [10 ** (m.back_log[h] + m.single_log[w] + gain.get(h << 16 | w, 0)) for w in ids.tolist()]
                assert sum(p) == pytest.approx(1)
        rare = rest[rest.kind == katz.WORD].n.to_numpy()
        assert (10 ** m.rare_log(rare)).sum() + 10**m.unseen_log == pytest.approx(1)
        scores.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in katz.score(texts, m, table).collect()})
    for other in scores[1:]:  # what is broadcast does not change a score
        assert all(other[i] == pytest.approx(scores[0][i]) for i in range(5))
    m, table = katz.fit(train.limit(0))
    assert all(np.isfinite(r.score) and r.n_known == 0 for r in katz.score(texts, m, table).collect())
    k = np.array([0, 1, 127, 128, 2**40, 2**63], np.uint64)
    assert katz.unpack(katz.pack(k)).tolist() == k.tolist() and len(katz.unpack(katz.pack(k[:0]))) == 0


def test_classifiers(spark, docs, none):
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, sentence(30) + (" you stupid clown, away" if bad else "") + ("!!! ### $$$" if i % 3 == 0 else "")))
        labels.append((i, int(i % 3 != 0), int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    train = F.col("doc_id") < 450
    for part, label, at in ((toxicity, "toxic", 2), (quality, "quality", 1)):
        model = part.fit(d, lab, label, train)
        held = {r.doc_id: r for r in part.score(d, model).where("doc_id >= 450").collect()}
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held.values())
        right = sum(held[i].predicted == labels[i][at] for i in range(450, 600))
        assert right >= 143, (label, right)
        assert part.score(docs, model).count() == len(ROWS) and part.score(none, model).count() == 0
        assert part.score(docs, part.fit(d, lab.limit(0), label, train)).count() == len(ROWS)
    model = toxicity.fit(d, lab, "toxic", train)
    kept = {r.doc_id for r in toxicity.reject(d.withColumn("h", F.lit(1)), model).collect()}
    assert kept == {r.doc_id for r in toxicity.score(d, model).where("predicted = 0").collect()}


def test_html_walk_is_json_safe():
    assert json.dumps(pages.text_blocks(pages.parse("<div hidden>x</div>y"))) == '["y"]'
