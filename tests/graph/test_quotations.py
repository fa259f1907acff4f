"""Candidates of passages by runs of tokens: every pair that isn't among them is missing."""

import random
from collections import Counter

from juriscope.functions import quotes
from juriscope.operators import quotations


def changed(rng, words):
    """A passage with a changed word, case or gap, now and then."""
    words = list(words)
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(words))
        kind = rng.randrange(4)
        if kind == 0:
            words[at] = "changed"
        elif kind == 1:
            words[at] = words[at].upper()
        elif kind == 2:
            words.insert(at, "gap word")
        else:
            words[at] += rng.choice([",", ".", "?", " …"])
    return " ".join(words)


def test_statuses_of_all_passages_in_all_texts(spark):
    rng = random.Random(8)
    # Words of one length, so that no word is the end or the start of another.
    word = lambda: "w" + format(rng.randrange(400), "03d")
    texts = [(d, " ".join(word() + rng.choice(["", "", "", "."]) for _ in range(rng.randrange(3, 120)))) for d in range(25)]
    passages = []
    for i in range(40):
        words = texts[rng.randrange(25)][1].split()
        at = rng.randrange(len(words))
        quote = words[at : at + rng.choice([2, 4, 6, 12, 30])]
        if i % 5 == 0:
            quote += texts[rng.randrange(25)][1].split()[:9]
        passages.append((i, changed(rng, quote)))
    t, p = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, quote string")
    pairs = quotations.candidates(p, t, "item_id", "quote", "doc_id", "text")
    from pyspark.sql import functions as F

    got = {(r.doc_id, r.item_id): r.status for r in pairs.select("doc_id", "item_id", quotes.status(F.col("quote"), F.array("text")).alias("status")).collect()}
    seen = Counter()
    for d, text in texts:
        stream = [quotes.Stream(quotes.tokens(text))]
        for i, quote in passages:
            want = quotes.verify(stream, quote)[0]
            seen[want] += 1
            assert got.get((d, i), "short" if want == "short" else "missing") == want, (text, quote)
    assert seen["found"] > 10 and seen["stitched"] + seen["partial"] > 5 and len(got) < 25 * 40 / 4


def test_empty_sides(spark):
    t, p = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "item_id long, quote string")
    assert quotations.candidates(p, t, "item_id", "quote", "doc_id", "text").count() == 0
