"""Packing, chat formatting, vectors, tokens, languages and quality."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from juriscope.llm import chat_format, language_id, packing, pu_quality, sentencepiece_stream, vector_search

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["ÀÉÏ õ½x²", "It\x85S", "a\xa0b\x1fc\x1cd", "oß’s", "L'ÉTÉ'S don't we'll", "é x", "İstanbul ſs ﬃ", "<|endoftext|> x<|startoftext|>y", "日本語 テスト", "\x00 \x01", "", " ", "\n\n", "Σας ΣΑΣ", "a|b<c>", "x" * 300]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(WORDS), packing.Encoder(WORDS, 2, cached=20)
    assert fast.quick
    for text in [*ODD, " ".join(ODD), *(chr(a) + chr(b) + "'S " for a in range(1, 256, 3) for b in range(32, 256, 5))]:
        want = plain.encode(text, add_special_tokens=False).ids + [2]
        assert list(struct.unpack(f"<{len(want)}I", next(fast([text])))) == want, text


def check_packing(rows, docs, size):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4 > 0
            at += r.length
        assert at <= size and (at & (at - 1) == 0 or at == size)
    assert set(pieces) == set(docs)
    for d, whole in docs.items():
        own = sorted(pieces[d], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == whole and all(r.doc_tokens == len(whole) // 4 for r in own)


@pytest.mark.parametrize("windows", [1, 4])
def test_packing_keeps_every_id_once(spark, odd_rows, no_docs, windows):
    rows = [(i, r[1]) for i, r in enumerate(odd_rows)] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    encode = packing.Encoder(WORDS, 2)
    got = packing.pack(docs, WORDS, 2, size=64, open_windows=windows, merge_parts=2).collect()
    check_packing(got, {d: next(encode([t or ""])) for d, t in rows}, 64)
    assert packing.pack(no_docs, WORDS, 2).count() == 0


def test_chat_round_trip(spark):
    nasty = ["", "<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "<\\|x", "<\\\\|", "<|", "<<|im_end|>|", "a<|im_end|>b", "\n", "<n|", "plain", None, "$1 \\1 \\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    rows += [(2, i, role, "t") for i, role in enumerate(["a\nb", "<|im_end|>", "<n|", "<\\n|x", None, "", "<\\|"])]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (3, None, "user", "first"), (None, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    chats = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    want = defaultdict(list)
    for c, n, role, t in rows:
        want[c].append((n is not None, n or 0, role or "", t or ""))
    assert set(chats) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in chats[c].turns] == [t[2:] for t in turns]
        assert chats[c].loss_text == "".join(t[3] for t in turns if t[2] == "assistant")
        assert chats[c].formatted.count("<|im_start|>") == chats[c].formatted.count("<|im_end|>") == len(turns)
    assert "plain<|im_end|>" in chats[1].formatted
    assert chat_format.read_back(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_vector_search_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = [rng.normal(0, 0.2, 8).tolist() for _ in range(700)]
    vectors[10:200] = [vectors[0]] * 190  # a hot vector: ties go to the smaller id
    rows = list(enumerate(vectors)) + [(900, [3e5, 1.0] * 4), (901, [1e6, 1.0] * 4), (950, [5e5, 2.0] * 4), (952, [2e7, -7e6] * 4), (700, None), (701, [float("nan")] * 8), (702, [None] + [0.1] * 7), (703, [math.inf] + [0.1] * 7), (704, []), (750, [0.1, 0.2]), (800, [0.3, 0.2]), (None, vectors[3]), (50, vectors[50])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = vector_search.top_k(frame, frame.filter("vec_id % 50 = 0"), k=5, block_rows=64, query_rows=5)
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    want = Counter()
    for q in {i for i in whole if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(whole[q][0], v, strict=True)), i) for i, vs in whole.items() if i != q for v in vs if len(v) == len(whole[q][0]))
        if q != 50:
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5]))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect() if r.query_id != 50) == want
    assert vector_search.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_scores_beyond_a_long_are_an_error(spark):
    frame = spark.createDataFrame([(0, [1e10]), (1, [1e10]), (2, [1e10])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        vector_search.top_k(frame, frame.filter("vec_id = 0")).collect()
    # Huge negative scores that are not among the best don't matter.
    frame = spark.createDataFrame([(0, [1e10]), (1, [1.0]), (2, [-1e30]), (3, [2.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vector_search.top_k(frame, frame.filter("vec_id = 0"), k=2).orderBy("rank").collect()] == [3, 1]


def test_components_beyond_all_bounds_lose_no_row(spark):
    """Sums that doubles can't bound are read exactly: here a score that a long can't hold."""
    rows = [(0, [1e160, 1.0]), (1, [0.0, 1.0]), (2, [-1e160, 2.0]), (3, [0.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        vector_search.top_k(frame, frame.filter("vec_id = 0")).collect()
    frame = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1e305, 3.0]), (2, [-1e305, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    found = vector_search.top_k(frame, frame.filter("vec_id = 0"), scale=1.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(3, 5), (1, 3), (2, 2)]


def test_queries_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "TASK_QUERIES", 40)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = Counter()
    exact = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for q in exact:
        best = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)[:3]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    got = vector_search.top_k(frame, frame, k=3, block_rows=50, query_rows=20)
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == want


def test_the_sample_of_a_fit_has_its_size_at_every_scale():
    for rows in (10**4, 10**9, 10**12, 10**15):
        share = min(1.0, 8192 / rows)
        assert abs(pu_quality.limit_of(share) / 2**63 - share) <= 1e-6 * share
    assert pu_quality.limit_of(1.0) == 2**63 - 1


def test_vector_search_skips_exact_reads():
    import numpy as np

    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.normal(0, 0.15, (4096, 64)))
    _, read = vector_search.search_block(np.arange(20), rows[:20], np.arange(4096), rows, 5, cell_bits=5)
    assert read < 0.15 * 20 * 4096


def unigram_model():
    """The model file, told to SentencePiece as a unigram model: an independent Viterbi."""
    import sentencepiece

    data = bytearray(open(PIECES, "rb").read())

    def number(i):
        x = shift = 0
        while True:
            x |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if not data[i - 1] & 128:
                return x, i

    def fields(i, end):
        while i < end:
            tag, j = number(i)
            if tag & 7 == 2:
                n, j = number(j)
                yield tag >> 3, j, j + n
                i = j + n
            elif tag & 7 == 5:
                yield tag >> 3, j, j + 4
                i = j + 4
            else:
                n, k = number(j)
                yield tag >> 3, j, k
                i = k

    for field, a, b in fields(0, len(data)):
        if field == 2:
            for inner, c, _ in fields(a, b):
                if inner == 3:
                    data[c] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


def test_streaming_viterbi_equals_whole_viterbi(odd_rows):
    other, codec = unigram_model(), sentencepiece_stream.Codec(PIECES)
    for text in [*ODD, "The quick brown fox", "  two  blanks ", "tabs\tand\nlines\n\nhere", "naïve façade Übergröße 漢字かな 😀", *[r[1] for r in odd_rows if r[1]], "nospacesatall" * 3000, "日本語テスト" * 500]:
        ids = codec.encode(text)
        got = list(struct.unpack(f"<{len(ids) // 4}I", ids))
        if "\x00" not in text:
            assert got == other.encode(text), text
        assert codec.decode(ids) == text


def test_streaming_viterbi_commits_early():
    import time

    v = sentencepiece_stream.Vocabulary(PIECES)
    text = "thequickbrownfoxjumpsoverthelazydog" * 400
    whole, parts = sentencepiece_stream.Stream(v), sentencepiece_stream.Stream(v)
    whole.feed(text, last=True)
    for i in range(0, len(text), 7):
        parts.feed(text[i : i + 7])
    parts.feed("", last=True)
    assert parts.ids == whole.ids and b"".join(v.text[i] for i in parts.ids).decode() == text
    assert max(parts.most, whole.most) < 4 * v.longest and whole.commits > len(text) / (2 * v.longest)
    # A megabyte without a blank goes through the operator's own path, in time that grows with it.
    took = []
    for n in (1 << 17, 1 << 20):
        codec, began = sentencepiece_stream.Codec(PIECES), time.process_time()
        ids = codec.encode(text[: len(text) // 35 * 35] * (n // len(text)) or text)
        took.append(time.process_time() - began)
        assert codec.commits > n / (4 * v.longest) and codec.most < 4 * v.longest and len(ids) > n / 4
    assert took[1] < 16 * took[0] + 1


def test_tokens_over_rows(spark, odd_docs, odd_rows, no_docs):
    rows = sentencepiece_stream.round_trip(odd_docs, PIECES).collect()
    assert len(rows) == len(odd_rows) and all(r.restored for r in rows)
    encoded = sentencepiece_stream.encode(odd_docs, PIECES)
    back = Counter((r.doc_id, r.text) for r in sentencepiece_stream.decode(encoded, PIECES).collect())
    assert back == Counter((r[0], r[1] or "") for r in odd_rows)
    assert sentencepiece_stream.round_trip(no_docs, PIECES).count() == 0


def test_language_profiles(spark, odd_docs, odd_rows, no_docs):
    seeds = {"en": "the cat and the dog went to the house with that", "de": "der Hund und die Katze gehen über die große Straße", "es": "el perro y la gata van por la calle señor"}
    rows = [(i, " ".join(text.split()[k:] + text.split()[:k]), lang) for k in range(6) for i, (lang, text) in enumerate(seeds.items())]
    docs = spark.createDataFrame([*rows, (90, None, "en"), (91, "the", None)], "doc_id long, text string, lang string")
    profiles = language_id.learn(docs)
    assert sorted(r.lang for r in profiles.collect()) == ["de", "en", "es"]
    asked = spark.createDataFrame([(1, "the dog and that house"), (2, "die Straße und der Hund"), (3, "la calle señor perro"), (4, None), (5, "123 ..."), (6, ""), (7, "THE DOG AND THAT HOUSE")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(asked, profiles).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["en", "de", "es", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and abs(got[1].score - got[7].score) < 1e-5
    assert language_id.identify(odd_docs, profiles).count() == len(odd_rows)
    # One language at a time gives the same.
    assert {(r.doc_id, r.lang_pred) for r in language_id.identify(asked, profiles, block=1).collect()} == {(i, r.lang_pred) for i, r in got.items()}
    none = language_id.learn(no_docs)
    assert language_id.identify(odd_docs, none).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(no_docs, profiles).count() == 0 and none.count() == 0


def slow_profile(text, dims=1024, seed=7):
    """A text's vector, letter by letter: bind, permute, bundle."""
    import numpy as np

    letters = language_id.letter_vectors(dims, seed).astype(int)
    marks = [0]
    for c in text:
        low = ord(c.lower()[0])
        mark = 0 if not c.isalpha() else low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 37
        if mark or marks[-1]:
            marks.append(mark)
    marks += [0] if marks[-1] else []
    total = np.zeros(dims)
    for a, b, c in zip(marks, marks[1:], marks[2:], strict=False):
        total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total


def test_profiles_against_brute_force(spark, odd_rows):
    import numpy as np

    rows = [(i, r[1], r[2]) for i, r in enumerate(odd_rows)] + [(100 + i, t, lang) for i, (t, lang) in enumerate([("abc déf, x", "x"), ("hello WORLD 7", "y"), ("zz top ü", "x"), ("ñandú çà", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {}
    for _, t, lang in rows:
        if t is not None and lang is not None:
            want[lang] = want.get(lang, 0) + slow_profile(t)
    learned = language_id.learn(docs)
    got = {r.lang: np.array(r.v) for r in learned.collect()}
    assert sorted(got) == sorted(want) and all(np.allclose(got[k], v) for k, v in want.items())
    found = {r.doc_id: r for r in language_id.identify(docs, learned).collect()}
    for i, t, _ in rows:
        v = slow_profile(t or "")
        cosines = {k: float(v @ p / (np.linalg.norm(v) * np.linalg.norm(p) or 1)) for k, p in want.items()}
        if not any(c.isalpha() for c in t or ""):
            assert (found[i].lang_pred, found[i].score) == ("und", 0)
        else:
            assert abs(cosines[found[i].lang_pred] - max(cosines.values())) < 1e-5 and abs(found[i].score - (max(cosines.values()) + 1) / 2) < 1e-5


@pytest.mark.parametrize("name, least", [("op1_pu_quality", 0.93), ("op8_hyperdimensional", 0.97)])
def test_held_out_accuracy(spark, name, least):
    from juriscope.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES[name](spark, d).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    if name.startswith("op1"):
        truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
        right = [got[i].predicted == q for i, q in truth.items() if got[i].held_out]
    else:
        right = [got[r.doc_id].lang_pred == r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    assert sum(right) / len(right) >= least


def test_pu_on_odd_rows(spark, odd_docs, odd_rows, no_docs):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(3, 1, 0), (4, 0, None), (6, None, 1), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = pu_quality.fit(odd_docs, labels, F.col("doc_id").isNotNull())
    rows = pu_quality.score(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert pu_quality.score(no_docs, pu_quality.fit(no_docs, labels.limit(0), F.lit(True))).count() == 0


def test_risk_is_held_above_zero():
    import numpy as np

    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, pu_quality.WIDTH)), rng.normal(-1, 1, (100, pu_quality.WIDTH))
    model = pu_quality.Model(0.75).fit(good[:150].astype("f4"), np.concatenate([good[150:], bad[:50]]).astype("f4"), steps=150)
    assert (model.score(good) > 0.5).mean() > 0.97 and (model.score(bad[50:]) < 0.5).mean() > 0.9


def test_loss_digest():
    assert hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest().startswith("3bfc6ead")


AWKWARD = ["_gone", "_f", "_d", "_", "_row", "_tid", "_lines", "_of", "_flags", "a b", "a.b", "A:B", "c0", "row", "lines", "gone", "left", "tid", "host", "of_host", "frequent", "`q`", "bucket", "part", "_part", "_text", "_id", "score_", "who", "h", "fp", "x", "_lang", "_cosine"]


def test_clashing_names_pass(spark):
    """Columns of any name come through operators that return their rows, and don't disturb the others."""
    from pyspark.sql import functions as F

    from juriscope.llm import line_dedup, quality_rules, simhash, substring_dedup

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + "\na line that all rows share", "en", "s", *[f"{c}{i}" for c in AWKWARD]) for i in range(6)]
    ticked = ["`" + c.replace("`", "``") + "`" for c in AWKWARD]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", *[f"{c} string" for c in ticked]]))
    want = {tuple(r[4:]) for r in rows}
    profiles = language_id.learn(docs)
    model = pu_quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.lit(True))
    results = [quality_rules.clean(docs, line_floor=9), line_dedup.dedup_lines(docs), substring_dedup.dedup_substrings(docs), pu_quality.score(docs, model), language_id.identify(docs, profiles)]
    for got in results:
        assert got.columns[: len(docs.columns)] == docs.columns
        assert {tuple(r) for r in got.select(*ticked).collect()} == want
    assert {r.text for r in pu_quality.score(docs, model).collect()} == {r[1] for r in rows}
    assert simhash.near_duplicates(docs).count() == sentencepiece_stream.encode(docs, PIECES).count() == 6
    assert packing.pack(docs, WORDS, 2).select("doc_id").distinct().count() == 6
    turns = docs.withColumnsRenamed({"doc_id": "conv_id", "lang": "role"}).withColumn("turn", F.lit(0))
    assert chat_format.format_chats(turns).count() == 6
    vectors = docs.withColumn("embedding", F.array(F.col("doc_id").cast("double"))).withColumnRenamed("doc_id", "vec_id")
    assert vector_search.top_k(vectors, vectors, k=1).count() == 6


def test_an_output_name_in_the_input_is_replaced(spark):
    docs = spark.createDataFrame([(1, "one two three", "old", 5, "old", 0.5)], "doc_id long, text string, spans string, n_lines int, lang_pred string, score double")
    from juriscope.llm import line_dedup, substring_dedup

    assert line_dedup.dedup_lines(docs).first().n_lines == 1
    assert substring_dedup.dedup_substrings(docs).first().spans == []
    assert language_id.identify(docs, language_id.learn(docs.limit(0), lang_col="text")).first().lang_pred == "und"


def slow_features(text):
    """Features of one text, counted byte by byte."""
    import numpy as np

    data = (text or "").encode()
    one, pair = np.zeros(256), np.zeros(pu_quality.PAIRS)
    for b in data:
        one[b] += 1
    for a, b in zip(data, data[1:], strict=False):
        pair[((a * 40503 + b * 26687) >> 5) % pu_quality.PAIRS] += 1
    words = data.split()
    again = [sum(words[i] == words[i - back] for i in range(back, len(words))) / max(len(words), 1) for back in (2, 1)]
    total = max(len(data), 1)
    blank = sum(data.count(b) for b in b" \t\n\x0b\x0c\r")
    shapes = [*map(math.sqrt, again), math.log1p(len(data)) / 10, len(data) / (blank + 1) / 10, sum(65 <= b < 91 for b in data) / total, len(data) == 0]
    return np.concatenate([np.sqrt(one / total), np.sqrt(pair / total), shapes])


def test_features_and_gradient_against_brute_force(odd_rows):
    import numpy as np
    import pyarrow as pa

    texts = [r[1] for r in odd_rows] + ["a a a b", "x y x y", "Ab\x0bC"]
    x = pu_quality.features(pa.array(texts, pa.string()))
    assert np.allclose(x, np.array([slow_features(t) for t in texts]), atol=1e-5)
    # One step of the fit goes down the slope of the risk, taken by differences.
    rng = np.random.default_rng(4)
    good, open_ = (rng.normal(m, 1, (60, pu_quality.WIDTH)).astype("f4") for m in (0.3, 0))
    p, model = 0.4, pu_quality.Model(0.4)
    model.fit(good, open_, steps=1, rate=1e-3, decay=0)
    both = np.concatenate([good, open_])
    mean, scale = both.mean(axis=0), 1 / np.maximum(both.std(axis=0), 0.02)
    bias = math.log(p / (1 - p))

    def risk(w):
        gx, gu = ((a - mean) * scale @ w + bias for a in (good.astype(float), open_.astype(float)))
        loss = lambda g, y: np.logaddexp(0, -g if y else g).mean()
        return p * loss(gx, 1) + max(0.0, loss(gu, 0) - p * loss(gx, 0))

    zero, at = np.zeros(pu_quality.WIDTH), np.arange(0, pu_quality.WIDTH, 37)
    slope = np.array([(risk(zero + 1e-5 * (np.arange(pu_quality.WIDTH) == i)) - risk(zero)) / 1e-5 for i in at])
    clear = np.abs(slope) > 1e-3
    assert clear.sum() > 5 and (np.sign(model.weights[at][clear]) == -np.sign(slope[clear])).all()
