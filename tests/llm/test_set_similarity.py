"""The near-duplicate stage against a brute-force version."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from juriscope.llm import simhash
from juriscope.llm import set_similarity
from test_text_operators import WORD, ascii_lower, bag


def grams(text):
    words = WORD.findall(ascii_lower(text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def fingerprint(text):
    import numpy as np

    hashes = simhash.shingle_hashes((text or "").encode(), 5, 42)
    return int(simhash.majority(np.array(hashes, np.uint64), np.array([0, len(hashes)]))[0])


def slow(rows):
    """(doc_id, component_id) of every row, all pairs compared: fingerprints and sets."""
    sets, prints = [grams(t) for _, t in rows], [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if sets[i] == sets[j] or (prints[i] ^ prints[j]).bit_count() <= 4 or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {x: min((d for (d, _), y in zip(rows, label, strict=True) if y == x and d is not None), default=None) for x in label}
    return Counter((d, least[x]) for (d, _), x in zip(rows, label, strict=True))


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = []
    common = [f"common{k}" for k in range(60)]
    for i in range(60):
        words = [f"t{i}w{rng.randrange(400)}" for _ in range(rng.randrange(30, 160))]
        words += common if i % 2 else []
        texts += [" ".join(words), edited(rng, words, rng.randrange(1, 6)), edited(rng, words, 1)]
    base = [f"b{k}" for k in range(120)]
    texts += [edited(rng, base, 1) for _ in range(40)]  # one large group
    return [(1000 - i, t) for i, t in enumerate(texts)]


def test_every_link_is_found(spark, rows, odd_rows):
    both = rows + [(d, t) for d, t, *_ in odd_rows]
    docs = spark.createDataFrame(both, "doc_id long, text string").repartition(3)
    want = slow(both)
    assert bag(set_similarity.near_duplicates(docs), "doc_id", "component_id") == want
    assert len({c for _, c in want}) < len(want) - 60


def test_no_documents(no_docs):
    assert set_similarity.near_duplicates(no_docs).count() == 0


def test_stage_drops_copies_of_similarity_0_8(spark):
    words = [f"w{k}" for k in range(104)]
    near = [*words[:50], "x", *words[51:]]  # 95 of 105 shingles
    far = [f"y{k}" if k in (10, 30, 50) else w for k, w in enumerate(words)]  # 85 of 115
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near(spark, docs, "").orderBy("doc_id").collect()] == [1, 3]


def test_another_text_of_a_repeated_id_stays(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, text("a")), (7, text("a")), (7, text("b"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert bag(corpus_pipeline.near(spark, docs, ""), "doc_id", "text") == Counter([rows[0], rows[2]])


def test_texts_of_one_template_meet_in_few_blocks():
    """Blocks hold few pairs of texts that share most of their words but not enough."""
    import numpy as np
    from juriscope.llm import jaccard_trie

    frame = [f"t{k}" for k in range(21)]
    sets = []
    for i in range(400):
        words = list(frame)
        for at, k in ((4, 0), (11, 1), (17, 2)):
            words.insert(at, f"own{i}x{k}")
        (items, _), *_ = jaccard_trie.shingle_sets(__import__("pyarrow").array([" ".join(words)]), 5)
        sets.append(items)
    firsts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    of, key = jaccard_trie.parts(np.concatenate(sets), firsts, 80)
    sizes = Counter(key.tolist())
    assert sum(n * (n - 1) // 2 for n in sizes.values()) < 0.35 * len(sets) * (len(sets) - 1) / 2


@pytest.mark.parametrize("columns", ["id long, body string, row string, sid string, tid string", "id long, body string, n string, keys string, block string"])
def test_clashing_names(spark, columns):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(3, text, "x", "y", "z"), (1, text + " more", "x", "y", "z"), (2, "other text", None, None, None)], columns)
    assert bag(set_similarity.near_duplicates(docs, "id", "body"), "doc_id", "component_id") == Counter([(3, 1), (1, 1), (2, 2)])
