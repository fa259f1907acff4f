"""Operators on texts against brute-force versions, odd rows included."""

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

from juriscope.llm import line_dedup, quality_rules, simhash, substring_dedup
from juriscope.llm.common import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_line_dedup(odd_docs, odd_rows, no_docs):
    key = lambda line: ascii_lower(line.strip(SPACE))
    owner = {}
    for d, t, *_ in odd_rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                owner[key(line)] = min(d, owner.get(key(line), d))
    want = Counter()
    for d, t, *_ in odd_rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or owner.get(key(x), d) == d]
        want[(d, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    got = line_dedup.dedup_lines(odd_docs)
    assert bag(got, "doc_id", "text", "n_lines", "n_dropped") == want
    assert set(odd_docs.columns) <= set(got.columns)
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_runs_compact_and_stay_disjoint(spark):
    runs = line_dedup.LineRuns(spark, 3, fan_in=2)
    for k in range(5):
        keys = spark.createDataFrame([(i, i * 7, k) for i in range(k * 5, k * 5 + 10)], "h1 long, h2 long, owner long")
        runs.add(keys)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    rows = runs.owners().collect()
    assert len({r.h1 for r in rows}) == len(rows) == 30
    assert all(r.owner == max(0, (r.h1 - 5) // 5) for r in rows)


def test_nothing_is_compacted_after_the_last_batch(spark, monkeypatch):
    made, write = [], line_dedup.LineRuns._write
    monkeypatch.setattr(line_dedup.LineRuns, "_write", lambda self, rows: made.append(write(self, rows)) or made[-1])
    docs = spark.createDataFrame([(d, f"the line of document {d % 30}\nthe line of document {d}") for d in range(80)], "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, batches=4)
    assert bag(got, "doc_id", "text") == Counter((d, f"the line of document {d}" if d >= 30 else t) for d, t in map(tuple, docs.collect()))
    assert len(made) == 5  # four batches and what the first two become


def test_runs_are_met_in_their_order_and_write_few_files(spark, monkeypatch):
    """Batches meet runs without dealing out or sorting those again; the files that are written
    follow their bytes, not the parts of all runs, and nothing stays persisted."""
    plans, unseen = [], line_dedup.LineRuns.unseen

    def planned(self, keys):
        rows = unseen(self, keys)
        plans.append((len(self.runs), str(rows._jdf.queryExecution().executedPlan())))
        return rows

    monkeypatch.setattr(line_dedup.LineRuns, "unseen", planned)
    root = Path(shared_folder(spark).removeprefix("file:"), spark.sparkContext.applicationId)
    files = lambda: set(root.rglob("part-*.parquet"))
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    old, shuffled, kept = files(), spark.conf.get("spark.sql.shuffle.partitions"), held()
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    # Joins by their order whatever the size of a side, as on large tables.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(d, "\n".join(f"line {d * 20 + k:09d}" for k in range(30))) for d in range(200)], "doc_id long, text string").coalesce(2)
        got = bag(line_dedup.dedup_lines(docs), "n_lines", "n_dropped")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(30, 0): 1, (30, 10): 199}
    assert [n for n, _ in plans] == [0, 1, 1, 2]
    for n, plan in plans:
        fresh = plan.split("InMemoryRelation")[0]  # below are the plans that made the runs
        assert len(re.findall("SortMergeJoin", fresh)) == n and len(re.findall(r"Exchange", fresh)) == 1 and len(re.findall(r"Sort \[", fresh)) == min(n, 1)
    assert len(files() - old) <= 2 + spark.sparkContext.defaultParallelism  # of lines and of owners
    assert held() == kept


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_substring_dedup(odd_docs, odd_rows, no_docs):
    owner = {}
    for d, t, *_ in odd_rows:
        if d is not None:
            for w in windows(WORD.findall(t or ""), 13):
                owner[w] = min(d, owner.get(w, d))
    want = Counter()
    for d, t, *_ in odd_rows:
        words = WORD.findall(t or "")
        gone = set()
        for i, w in enumerate(windows(words, 13)):
            if d is not None and owner[w] < d:
                gone |= set(range(i, i + 13))
        want[(d, " ".join(w for i, w in enumerate(words) if i not in gone), len(words), len(gone))] += 1
    got = substring_dedup.dedup_substrings(odd_docs)
    assert bag(got, "doc_id", "text", "n_words", "n_removed") == want
    assert bag(got, "_row", "lang", "source") == bag(odd_docs, "_row", "lang", "source")
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got.collect())
    assert substring_dedup.dedup_substrings(no_docs).count() == 0
    # Another window, found from other seeds.
    assert substring_dedup.dedup_substrings(odd_docs, window=4).filter("n_removed > 0").count() > 3


def test_texts_without_a_window(spark):
    docs = spark.createDataFrame([(i, "few words only") for i in range(5)], "doc_id long, text string")
    assert bag(substring_dedup.dedup_substrings(docs), "text", "n_words", "n_removed") == {("few words only", 3, 0): 5}


def test_words_that_sums_of_powers_confuse(spark):
    thue = ["a"]
    for _ in range(12):
        thue = thue + ["b" if c == "a" else "a" for c in thue]
    one = "".join(thue)
    other = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    assert bag(substring_dedup.dedup_substrings(docs), "doc_id", "n_removed") == Counter([(1, 0), (2, 0), (3, 13)])


def test_levels_double():
    assert substring_dedup.levels(13) == [4, 7, 13] and substring_dedup.levels(4) == [4] and substring_dedup.levels(50, 5) == [4, 7, 13, 25, 50]


def slow_fingerprint(text):
    import xxhash

    words = WORD.findall(ascii_lower(text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    return find


def test_near_duplicates(odd_docs, odd_rows, no_docs):
    marks = [(d, slow_fingerprint(t)) for d, t, *_ in odd_rows]
    find = slow_components({f for _, f in marks})
    least = defaultdict(list)
    for d, f in marks:
        least[find(f)] += [d] if d is not None else []
    want = Counter((d, f - (1 << 64) * (f >> 63), min(least[find(f)], default=None)) for d, f in marks)
    assert bag(simhash.near_duplicates(odd_docs), "doc_id", "fp", "component_id") == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_trie_finds_every_link(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 400, dtype=np.uint64) << np.uint64(1)
    for _ in range(5):  # chains of near codes, up to seven bits apart
        near = codes.copy()
        for _ in range(rng.integers(1, 8)):
            near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
        codes = np.unique(np.concatenate([codes, near[:150]]))
    codes = np.concatenate([codes, np.arange(300, dtype=np.uint64)])  # one dense cluster
    codes = np.unique(codes)
    for bits in (0, 1, 3, 4, 6):
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits
        label = np.arange(len(codes))
        while True:
            low = np.where(near, label[None, :], len(codes)).min(axis=1)
            if (low == label).all():
                break
            label = low
        frame = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
        edges = simhash.links(frame, bits, task_codes=50)
        assert all((int(r.u) & (2**64 - 1) ^ int(r.v) & (2**64 - 1)) >= 0 for r in edges.take(1))
        roots = {r.node: r.root for r in simhash.contract(edges).collect()} if bits else {}
        got = [roots.get(int(x), int(x)) for x in codes.view(np.int64)]
        groups, want = defaultdict(set), defaultdict(set)
        for x, g, w in zip(codes, got, label, strict=True):
            groups[g].add(x)
            want[w].add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_quality_rules(odd_docs, odd_rows, no_docs, spark):
    got = quality_rules.judge(odd_docs)
    want = Counter()
    for d, t, *_ in odd_rows:
        words = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        counts = Counter(windows(words, 8))
        covered = {i + k for i, w in enumerate(windows(words, 8)) if counts[w] > 1 for k in range(8)}
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        want[(d, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed)] += 1
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert quality_rules.judge(no_docs).count() == 0
    assert bag(quality_rules.clean(odd_docs), "doc_id") == bag(got.filter("kept"), "doc_id")
    assert quality_rules.clean(no_docs).count() == 0


def slow_rules(rows, share=0.05, floor=3, least_left=0.7):
    """(verdict, cleaned text) of every row (id, text, host), by the rules as written."""
    normal = lambda line: " ".join(WORD.findall(line)).lower()
    documents, lines = defaultdict(set), defaultdict(set)
    for d, t, host in rows:
        who = (d, None if d is not None else t)
        documents[host or ""].add(who)
        for line in (t or "").split("\n"):
            lines[host or "", normal(line)].add(who)
    out = []
    for _d, t, host in rows:
        often = lambda x: x and len(lines[host or "", x]) > floor and len(lines[host or "", x]) > share * len(documents[host or ""])  # noqa: B023, E731
        words, texts = WORD.findall(t or ""), (t or "").split("\n")
        counts = Counter(windows(words, 8))
        covered = {i + k for i, w in enumerate(windows(words, 8)) if counts[w] > 1 for k in range(8)}
        gone = sum(len(WORD.findall(x)) for x in texts if often(normal(x)))
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        out.append((not failed and len(words) - gone >= least_left * len(words), "\n".join(x for x in texts if not often(normal(x))), failed))
    return out


def test_verdicts_and_cleaned_texts(spark, odd_rows):
    menu = "Home | About us | Contact our team | Sign in"
    body = lambda d, n: " ".join(f"w{d}x{k}" for k in range(n))
    rows = [(i, f"{menu}\n{body(i, 40)}\n Share  this\tpage ", "a" if i < 30 else "b") for i in range(40)]
    rows += [(100 + i, f"{menu}\n{body(100 + i, 14)}\nshare THIS page", "a") for i in range(2)]  # depleted
    rows += [(200 + i, f"{menu}\n{body(200 + i, 40)}", "c") for i in range(3)]  # three documents are under the floor
    rows += [(7, f"only here\n{body(7, 30)}", "d")] * 9 + [(None, f"{menu}\n{body(0, 40)}", "c")] * 9 + [(0, f"{body(1, 40)}\nx", "b")]
    rows += [(300 + r[0] if r[0] is not None else None, r[1], r[3]) for r in odd_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = slow_rules(rows)
    got = bag(quality_rules.judge(docs), "doc_id", "base_failed", "kept")
    assert got == Counter((r[0], w[2], w[0]) for r, w in zip(rows, want, strict=True))
    assert got[100, False, False] == got[101, False, False] == 1
    assert bag(quality_rules.clean(docs), "doc_id", "text", "source") == Counter((r[0], w[1], r[2]) for r, w in zip(rows, want, strict=True) if w[0])


def test_rules_decide_on_the_table(spark):
    from juriscope.llm.queries import QUERIES

    verdicts = QUERIES["op3_line_frequency"](spark, "/root/testdata/sf0.01")
    assert 0 < verdicts.filter("kept = base_failed").count() < 20


def test_query_digests(spark):
    from juriscope.llm.queries import QUERIES

    rows = QUERIES["op4_line_runs"](spark, "/root/testdata/sf0.001").collect()
    assert all(re.fullmatch("[0-9a-f]{64}", r.kept_sha256) for r in rows)
    assert hashlib.sha256(b"").hexdigest() not in {r.kept_sha256 for r in rows if not r.n_dropped}
