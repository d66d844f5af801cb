import random

import duckdb

from ledgerloom.llm import oracles
from ledgerloom.llm.decontam import leaks
from ledgerloom.llm.registry import op4_decontamination

ITEM = "Anna has 12 apples and gives Bert 5 apples before she walks 3 km to the market where Bert waits. How many apples are left?"


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string, h long")
    return sorted((r.doc_id, r.item_id, r.matched, r.windows, r.renamed) for r in leaks(d, b, **more).collect())


def test_reparameterised_and_inconsistent(spark):
    frame = "Some words come first, then this: {} And after that a little more text follows here."
    same = frame.format(ITEM)
    renamed = same.replace("Bert", "Carl").replace("12", "31").replace("5 apples", "7 apples").replace("3 km", "9 miles")
    mixed = renamed.replace("where Carl waits", "where Otto waits")
    loud = same.replace("gives", "GIVES,").replace("apples and", "*apples* \n and")
    other = "A quite different text about apples and the market where nobody waits for 12 km. " * 4
    got = run(spark, [(1, same, "a"), (2, renamed, "a"), (3, mixed, "b"), (4, loud, None), (5, other, "c")], [(7, ITEM, 0)])
    assert {(d, i, r) for d, i, _, _, r in got} == {(1, 7, False), (2, 7, True), (4, 7, False)}


def test_edge_rows(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, " . ! ", "a"), (None, ITEM, "a"), (4, ITEM, "a"), (4, ITEM, "a"), (5, "x " * 50_000 + ITEM, "a"), (6, "one two three", "a"), (7, "12 34 56", "a")]
    items = [(1, ITEM, 0), (1, ITEM, 0), (2, None, 0), (3, "", 0), (4, "12 34 56", 0), (5, "one two three", 0), (None, "seven words that stand for nothing else", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string, h long")
    return sorted((r.doc_id, r.item_id, r.matched, r.windows, r.renamed) for r in leaks(d, b, **more).collect())


def test_reparameterised_and_inconsistent(spark):
    frame = "Some words come first, then this: {} And after that a little more text follows here."
    same = frame.format(ITEM)
    renamed = same.replace("Bert", "Carl").replace("12", "31").replace("5 apples", "7 apples").replace("3 km", "9 miles")
    mixed = renamed.replace("where Carl waits", "where Otto waits")
    loud = same.replace("gives", "GIVES,").replace("apples and", "*apples* \n and")
    other = "A quite different text about apples and the market where nobody waits for 12 km. " * 4
    got = run(spark, [(1, same, "a"), (2, renamed, "a"), (3, mixed, "b"), (4, loud, None), (5, other, "c")], [(7, ITEM, 0)])
    assert {(d, i, r) for d, i, _, _, r in got} == {(1, 7, False), (2, 7, True), (4, 7, False)}


def test_edge_rows(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, " . ! ", "a"), (None, ITEM, "a"), (4, ITEM, "a"), (4, ITEM, "a"), (5, "x " * 50_000 + ITEM, "a"), (6, "one two three", "a"), (7, "12 34 56", "a")]
    items = [(1, ITEM, 0), (1, ITEM, 0), (2, None, 0), (3, "", 0), (4, "12 34 56", 0), (5, "one two three", 0), (None, "seven words that stand for nothing else", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string, h long")
    pairs = {(r.doc_id, r.item_id) for r in leaks(d, b).collect()}
    assert pairs == {(None, 1), (4, 1), (5, 1), (6, 5)}
    assert leaks(d.limit(0), b).count() == 0 and leaks(d, b.limit(0)).count() == 0


def test_renamed_items_are_found(spark):
    """Recall over re-parameterised questions: other names (also where they open sentences), numbers and units."""
    names, units = ["Anna", "Bert", "Carla", "Dmitri", "Elif", "Farid", "Greta", "Hugo"], ["km", "miles", "kg", "hours"]
    forms = [
        "{a} has {x} apples and gives {b} {y} apples before she walks {z} {u} to the market where {b} waits. How many apples are left?",
        "{a} buys {x} pens at the small shop. {a} then sells {y} of the pens to {b} for {z} cents each. How many pens does {a} still have?",
        "A train that {a} takes covers {x} {u} in the first hour and {y} {u} in the next. How far has {a} come after {z} hours of travel?",
    ]
    rng = random.Random(4)

    def told(form):
        (a, b), (x, y, z) = rng.sample(names, 2), rng.sample(range(3, 90), 3)
        return form.format(a=a, b=b, x=x, y=y, z=z, u=rng.choice(units))

    items = [(i, told(f), 0) for i, f in enumerate(forms)]
    docs = [(3 * j + i, f"Some text stands before it. {told(f)} And some more text follows after that.", "") for j in range(20) for i, f in enumerate(forms)]
    found = {(d, i) for d, i, *_ in run(spark, docs, items)}
    assert found <= {(d, d % 3) for d, *_ in docs} and len(found) >= 0.9 * len(docs)


def test_registered_query(spark):
    d = "/root/testdata/sf0.01"
    for t in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {t} as select * from '{d}/{t}.parquet'")
    got = sorted(map(tuple, op4_decontamination(spark, d).select("doc_id", "item_id", "matched", "windows", "renamed").collect()))
    assert got == sorted(duckdb.sql(oracles.DECONTAMINATION).fetchall())
    docs, items = (duckdb.sql(f"select * from {t}").fetchall() for t in ("documents", "benchmark"))
    assert {(x[0], y[0]) for x in docs for y in items if y[1] in x[1]} <= {(r[0], r[1]) for r in got}
