"""The pipeline, stage by stage and whole, against brute-force versions."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from juriscope.llm import packing
from test_set_similarity import edited, slow
from test_text_operators import SPACE, WORD, ascii_lower, slow_rules, windows

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows(odd_rows):
    """(doc_id, text, lang, source, n_chars): all the odd rows, menus, near copies, shared passages."""
    rng = random.Random(11)
    out = [(r[0], r[1], r[2], r[3], r[4]) for r in odd_rows]
    passage = " ".join(f"passage{k}" for k in range(60))
    for i in range(30):
        words = [f"d{i}w{rng.randrange(300)}" for _ in range(rng.randrange(30, 200))]
        text = " ".join(words)
        out.append((100 + i, f"Home | About us\n{text}\n{passage if i % 3 else ''}\nShare this page", "en", "host", None))
        out.append((200 + i, edited(rng, words, 1), "de", "other", 5))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, KINDS).repartition(3)


def texts(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def slow_lines(rows):
    key = lambda line: ascii_lower(line.strip(SPACE))
    owner = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                owner[key(line)] = min(d, owner.get(key(line), d))
    return [(d, "\n".join(x for x in (t or "").split("\n") if d is None or owner.get(key(x), d) == d), *rest) for d, t, *rest in rows]


def slow_near(rows):
    """A row goes where the class of its text has a smaller id."""
    least = {t: component(rows, t) for _, t, *_ in rows}
    return [r for r in rows if r[0] is None or least[r[1]] is None or least[r[1]] == r[0]]


_COMPONENTS = {}


def component(rows, text):
    """The smallest id of the class of ``text``."""
    key = id(rows)
    if key not in _COMPONENTS:
        # Rows get numbers of their own, so that each text's class can be read off.
        numbered = slow([(i, r[1]) for i, r in enumerate(rows)])
        root = dict(numbered.keys())
        groups = defaultdict(list)
        for i, r in enumerate(rows):
            groups[root[i]].append(r[0])
        least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
        _COMPONENTS[key] = {r[1]: least[root[i]] for i, r in enumerate(rows)}
    return _COMPONENTS[key][text]


def slow_passages(rows):
    owner = {}
    for d, t, *_ in rows:
        for w in windows(WORD.findall(t or ""), 13):
            if d is not None:
                owner[w] = min(d, owner.get(w, d))
    out = []
    for d, t, *rest in rows:
        words, gone = WORD.findall(t or ""), set()
        for i, w in enumerate(windows(words, 13)):
            if d is not None and owner[w] < d:
                gone |= set(range(i, i + 13))
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        out += [(d, left, *rest)] if left else []
    return out


def slow_quality(rows):
    verdicts = slow_rules([(d, t, s) for d, t, _, s, _ in rows])
    return [(d, v[1], *rest) for (d, _, *rest), v in zip(rows, verdicts, strict=True) if v[0]]


STEPS = {"quality_rules": slow_quality, "line_dedup": slow_lines, "near_dedup": slow_near, "substring_dedup": slow_passages}


@pytest.mark.parametrize("name", STEPS)
def test_each_stage(spark, rows, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for some in (rows, []):
        got = stage(spark, table(spark, some), "")
        assert got.columns == corpus_pipeline.COLUMNS
        want = STEPS[name](some) if some else []
        assert texts(got) == Counter((d, t, lang, source) for d, t, lang, source, _ in want)
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)


def test_the_whole_run(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = rows
    for step in STEPS.values():
        want = step(want)
    assert 20 < len(want) < len(rows)
    alone = Counter(r[0] for r in want)
    want = [r for r in want if alone[r[0]] == 1]
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    whole = {r[0]: next(encode([r[1]])) for r in want}
    pieces, sequences = defaultdict(list), Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id] += r.length
    assert set(pieces) == set(alone) and all(n == 4096 or n & (n - 1) == 0 for n in sequences.values())
    for d, ids in whole.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(ids)
