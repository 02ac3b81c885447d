"""Decontamination judges rows by id and text, and re-parameterised items in all their forms."""

from arrowleaf.llm import decontaminate

ITEM = "the quick brown fox jumps over the lazy dog near the river bank today"


def test_rows_of_one_id_are_judged_apart(spark):
    words = ITEM.split()
    rows = [(None, f"before {ITEM} after"), (None, "a clean text of some other words altogether"), (None, None)]
    rows += [(1, " ".join(words[:8])), (1, " ".join(words[6:]))]  # together they would cover the item
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()] == [(None, 7)]
    left = {(r.doc_id, r.text) for r in decontaminate.clean(docs, bench).collect()}
    assert left == set(rows[1:])


def test_opening_names_and_attached_numbers(spark):
    bench = [
        (1, "Alice has 5 apples. Bob has 3 apples. Alice eats 2 apples."),
        (2, "a bag of flour weighs 5kg and the road is 120km long where x=6 holds"),
    ]
    docs = [
        (10, "Carol has 7 apples. Dave has 4 apples. Carol eats 9 apples."),
        (11, "Carol has 7 apples. Dave has 4 apples. Erin eats 9 apples."),  # Alice is two names
        (12, "text before a bag of flour weighs 8kg and the road is 70 km long where x=2 holds"),
    ]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(10, 1, "reparameterised"), (12, 2, "reparameterised")}
