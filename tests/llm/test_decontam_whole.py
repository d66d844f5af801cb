"""Copies that the windows of templates used to miss."""

from ledgerloom.llm.decontam import leaks


def found(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.matched, r.windows, r.renamed) for r in leaks(d, b).collect())


def test_short_item_inside_a_document(spark):
    docs = ["We were asked this. What is the capital of France? Nobody in the room could tell.", "What is the capital of Spain? And so on it went for an hour.", "What is a capital of France?"]
    got = found(spark, docs, ["What is the capital of France?", "one two three"])
    assert [(d, i, m, w) for d, i, m, w, _ in got] == [(0, 0, 1, 1), (1, 0, 1, 1)] and [r[4] for r in got] == [False, True]


def test_names_that_open_sentences(spark):
    maria, ken = "Maria has 12 red apples. Maria buys 7 more.", "Ken bought 4 pens. Ken sold 2 pens. Ken kept the rest. How many did Ken keep?"
    docs = ["Olga has 15 red apples. Olga buys 9 more.", ken.replace("Ken", "Tom"), "It is said that Maria has 12 red apples. Maria buys 7 more.", "The cat has no red apples. The dog buys none."]
    assert found(spark, docs, [maria, ken]) == [(0, 0, 2, 2, True), (1, 1, 10, 10, True), (2, 0, 1, 2, False)]


def test_exact_copy_of_few_literals(spark):
    sums = "Solve 3 x 12 = 36, 4 x 12 = 48."
    docs = [f"A page of sums. {sums} And there it ends.", sums.replace("36", "37").replace("48", "49")]
    assert found(spark, docs, [sums]) == [(0, 0, 2, 2, False)]


def test_one_altered_value(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(42)]
    words[4] = words[36] = "5"
    item = " ".join(words)
    one = " ".join([*words[:36], "6", *words[37:]])
    pears = item.replace("5", "7", 1)
    got = found(spark, [one, pears.replace("7", "6").replace("5", "6")], [item, pears])
    assert {(d, i) for d, i, *_ in got} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert [r[2:] for r in got if r[:2] == (0, 0)] == [(29, 35, False)]
