"""Re-told benchmark items with lists of their own: units, names, signs, short items."""

import pytest
from fixtures import frame
from opsgraph.llm import decontaminate

PAIRS = [
    ("Anna paid $5 and 2 pounds of the sugar for a big cake that costs 7 dollars in the shop around the corner of her street",
     "Boris paid $6 and 3 kilograms of the sugar for a big cake that costs 9 dollars in the shop around the corner of her street"),
    ("how many boxes of green tea does Mary sell to Tom when he asks for 12 of them at the end of the day",
     "how many boxes of green tea does O'Brien sell to Jean-Luc when he asks for 15 of them at the end of the day"),
    ("the road from the old mill to the bridge is 12 miles long and it takes Anna Smith about 3 hours to walk all of it back home",
     "the road from the old mill to the bridge is 19 kilometers long and it takes Ludwig van Beethoven about 4 days to walk all of it back home"),
    ("the water in the pot has a temperature of -5 degrees and rises by 1/2 of a degree with every minute that passes by the window",
     "the water in the pot has a temperature of 17 degrees and rises by 3/4 of a degree with every minute that passes by the window"),
    ("a rope of 30 feet is cut so that one of the pieces is 6 inches longer than the other one, how long are both of the pieces",
     "a rope of 45 yards is cut so that one of the pieces is 9 millimetres longer than the other one, how long are both of the pieces"),
]


@pytest.mark.parametrize("item, told", PAIRS)
def test_retold(spark, item, told):
    docs = ["Some words before it. " + told + ". And some words after it.", "Some words before it. " + item, "a text of other words that has nothing of the kind in it at all and ends after a while"]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"] for r in decontaminate.leaks(frame(spark, list(enumerate(docs))), bench).collect() if r["contaminated"]}
    assert got == {0, 1}


def test_short_items_inside_other_texts_are_chance(spark):
    docs = ["asked how are you doing in the long letter", "How are you?", "3 a day keeps it away from all of us"]
    bench = spark.createDataFrame([(1, "how are you"), (2, "3 a day")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, list(enumerate(docs))), bench).collect() if r["contaminated"]}
    assert got == {(1, 1)}


def test_tokens():
    def kinds(text):
        import numpy as np

        raw = text.encode()
        buf = np.frombuffer(raw, np.uint8)
        start, end, _, kind, _ = decontaminate.template_tokens(buf, np.array([0, len(raw)]))
        return [("LNUP"[k], raw[a:b].decode()) for a, b, k in zip(start, end, kind)]

    assert kinds("take -5 kilograms or 1/2 pound") == [("L", "take"), ("N", "-5"), ("U", "kilograms"), ("L", "or"), ("N", "1/2"), ("U", "pound")]
    assert kinds("5-7 a day, O'Brien and Jean-Luc de la Tour") == [("N", "5"), ("N", "7"), ("L", "a"), ("L", "day"), ("P", "O'Brien"), ("L", "and"), ("P", "Jean-Luc de la Tour")]
    assert kinds("-3") == [("N", "-3")] and kinds("a-3") == [("L", "a"), ("N", "3")] and kinds("") == []
