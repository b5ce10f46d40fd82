"""Short items inside longer documents, and every window of an item."""

import random

from strataspark.llm import decontaminate


def test_short_items_and_further_windows(spark):
    rng = random.Random(2)
    fill = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    long = " ".join(f"q{k}" for k in range(20))
    rows = [(1, f"{fill(9)} Alpha, beta {fill(9)} alpha beta"), (2, f"{fill(9)} alpha {fill(9)} beta"), (3, f"{fill(7)} {long} {fill(50)} {long} {long}"), (4, "one"), (5, "one two"), (6, f"w x y z {fill(3)}"), (7, "x x x x x x"), (8, None)]
    items = [(10, "alpha beta"), (11, long), (11, long), (12, "one two three"), (13, "w x y z"), (14, "one"), (15, "x x")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_items, list(r.item_ids), r.spans) for r in decontaminate.report(docs, bench).collect()}
    assert got == {
        1: (1, [10], "10:9:2,10:20:2"), 2: (0, [], ""), 3: (2, [11], "11:7:20,11:7:20,11:77:20,11:77:20,11:97:20,11:97:20"), 4: (1, [14], "14:0:1"), 5: (1, [14], "14:0:1"),
        6: (1, [13], "13:0:4"), 7: (1, [15], "15:0:2,15:2:2,15:4:2"), 8: (0, [], ""),
    }
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 8}
