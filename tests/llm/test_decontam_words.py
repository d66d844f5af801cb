"""Words and templates are made of whole texts: few steps a word, and the words that the rules name."""

import random
import re

from ledgerloom.llm.decontam import DELETED, UNITS, _templates


def plain(text):
    t = "".join(c for c in (text or "").replace("\n", " . ") if c not in DELETED)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    out = []
    for i, w in enumerate(words):
        core = w.strip(".!?")
        low, begins = core.lower(), i == 0 or words[i - 1][-1] in ".!?"
        if not low:
            continue
        if re.search("[0-9]", core):
            out.append((low, "#num", "#num"))
        elif low in UNITS:
            out.append((low, "#unit", "#unit"))
        elif len(core) > 1 and core[0] != low[0] and core[1:] == low[1:]:
            out.append((low, low if begins else "#name", "#name"))
        else:
            out.append((low, low, low))
    return out


def test_templates_of_odd_texts(spark):
    rng = random.Random(3)
    parts = [*DELETED, *".!?" * 4, *" \t\n\r\x0b\x0c" * 4, "Anna", "Bert", "km", "12", "a1", "Über", "été", "USD", "A", "the", "‧", "―", " ", "😀"]
    texts = [None, "", " ", ".", "\n", ". !", ".A", "A..b.", *("".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for r in _templates(df).collect():
        assert list(zip(r.v, r.t, r.u)) == plain(texts[r.i]), texts[r.i]


def test_no_step_a_character_and_few_a_word(spark):
    plan = _templates(spark.createDataFrame([(1, "Anna has 5 apples.")], "i long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and plan.count("lambdafunction(") <= 4
