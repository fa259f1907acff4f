"""N-gram Jaccard joins, conversation repair and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from juriscope.llm import conversation_repair, conversation_trie, jaccard_trie, queries
from test_text_operators import WORD, ascii_lower, bag

TURNS = "conv_id long, turn long, role string, text string, h string, head string, present string, _row int"


# ------------------------------------------------------------------- op11: sets
def grams(text, shingle=3):
    words = WORD.findall(ascii_lower(text or ""))
    return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def classes(rows, percent, shingle=3):
    sets = [grams(t, shingle) for _, t in rows]
    label = list(range(len(rows)))
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    while True:
        new = [min([label[i], *(label[j] for j in range(len(rows)) if near(sets[i], sets[j]))]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = {x: min((d for (d, _), y in zip(rows, label, strict=True) if y == x and d is not None), default=None) for x in label}
    return Counter((d, len(s), least[x] if s else d) for (d, _), s, x in zip(rows, sets, label, strict=True))


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(3)
    texts = []
    for i in range(50):
        words = [f"w{rng.randrange(50)}" if i % 3 else f"t{i}x{rng.randrange(900)}" for _ in range(rng.choice([1, 2, 3, 12, 30, 70, 200]))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for _ in range(rng.randrange(1, 1 + max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    base = [f"b{k}" for k in range(150)]
    for k in range(40):  # one large group
        texts.append(" ".join(base[:k] + ["odd" + str(k)] + base[k + 1 :]))
    return [(2000 - i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("items", [1 << 20, 1500])
def test_similar_sets(spark, near_copies, odd_rows, items, monkeypatch):
    """With blocks that fit a task, and with blocks cut into chunks."""
    monkeypatch.setattr(jaccard_trie, "TASK_ITEMS", items)
    rows = near_copies + [(d, t) for d, t, *_ in odd_rows]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sid string, block int").repartition(3)
    want = classes(rows, 90)
    assert bag(jaccard_trie.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == want
    assert 60 < len({c for _, _, c in want}) < len(want) - 40


def test_other_similarity_and_length(spark, near_copies):
    docs = spark.createDataFrame(near_copies, "doc_id long, text string")
    assert bag(jaccard_trie.near_duplicates(docs, shingle=2, percent=60), "doc_id", "n_shingles", "component_id") == classes(near_copies, 60, 2)


def test_no_documents(no_docs):
    assert jaccard_trie.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("percent", [100, 90, 80, 50, 30])
def test_similar_sets_share_a_part_and_tries_link_them(percent):
    rng, some = np.random.default_rng(percent), random.Random(percent)
    for _ in range(8):
        sets = {}
        for _ in range(some.randrange(1, 12)):
            a = np.unique(rng.integers(0, 1 << some.choice([6, 63]), some.choice([1, 2, 5, 9, 10, 19, 40, 300]), dtype=np.uint64))
            sets[a.tobytes()] = a
            for _ in range(some.randrange(8)):
                gone = some.randrange(0, max(1, len(a) // 6) + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[min(gone, len(a) - 1) :], rng.integers(0, 1 << 63, some.randrange(gone + 1), dtype=np.uint64)]))
                sets[b.tobytes()] = b
        sets = list(sets.values())
        firsts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        of, key = jaccard_trie.parts(np.concatenate(sets), firsts, percent)
        keys = [set(key[of == i].tolist()) for i in range(len(sets))]
        links = [(i, j) for i in range(len(sets)) for j in range(i) if (100 + percent) * len(np.intersect1d(sets[i], sets[j])) >= percent * (len(sets[i]) + len(sets[j]))]
        assert all(keys[i] & keys[j] for i, j in links)
        blocks = [some.randrange(3) for _ in sets]
        u, v = jaccard_trie._forest([((b,), i, s) for i, (b, s) in enumerate(zip(blocks, sets, strict=True))], percent)
        assert components(len(sets), zip(u.tolist(), v.tolist(), strict=True)) == components(len(sets), [(i, j) for i, j in links if blocks[i] == blocks[j]])


def components(n, links):
    root = list(range(n))
    for a, b in links:
        a, b = root[a], root[b]
        root = [min(a, b) if x in (a, b) else x for x in root]
    return root


# ----------------------------------------------------------------- op12: repair
def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired): every string of edits with up to three inserts in a row."""
    found = faults(rows)
    best = [(10**9, "", [])]

    def go(k, state, cost, audit, out, inserts):
        if (cost, audit) > best[0][:2] and cost > best[0][0]:
            return
        if k == len(rows) and state in (0, 3):
            best[0] = min(best[0], (cost, audit, out))
        if inserts < 3:
            role = "assistant" if state == 2 else "user"
            go(k, 3 if state == 2 else 2, cost + 5, audit + "I", [*out, (role, "")], inserts + 1)
        if k == len(rows):
            return
        role, text = rows[k]
        go(k + 1, state, cost + 2, audit + "D", out, 0)
        if found[k] in (1, 2):
            return
        more = 5 * (found[k] == 3)
        due = "assistant" if state == 2 else "user"
        go(k + 1, 3 if state == 2 else 2, cost + 1 + more, audit + "R", [*out, (due, text)], 0)
        if role[:1] == due[:1] or (role[:1] == "s" and state == 0):
            go(k + 1, 1 if role[:1] == "s" else 3 if state == 2 else 2, cost + more, audit + "K", [*out, (role, text)], 0)

    go(0, 0, 0, "", [], 0)
    return best[0]


def random_turns(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "ux"]), rng.choice(["Yes.", "No", " \t", "", "Why?", f"Line {rng.randrange(9)}\nend! "])) for _ in range(n)]


def by_repair(rows):
    out = []
    repair = conversation_repair.Repair(lambda role, text, edit: out.append((role, text)))
    for k, ((role, text), fault) in enumerate(zip(rows, faults(rows), strict=True)):
        repair.turn(k, role, text, fault)
    *_, cost, audit = repair.end()
    return cost, audit, out


def test_cheapest_edits():
    rng = random.Random(2)
    for _ in range(250):
        rows = random_turns(rng, rng.randrange(6))
        assert by_repair(rows) == cheapest(rows), rows


def plain(rows):
    """The same pass with whole strings and no state left out."""
    layer = {0: (0, ""), 1: (10**9, ""), 2: (10**9, ""), 3: (10**9, "")}
    to = {0: 2, 1: 2, 2: 3, 3: 2}

    def close():
        for _ in range(4):
            for s, t in to.items():
                layer[t] = min(layer[t], (layer[s][0] + 5, layer[s][1] + "I"))

    close()
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        new = {s: (c + 2, e + "D") for s, (c, e) in layer.items()}
        for s, (c, e) in layer.items():
            if fault in (1, 2):
                continue
            more, t = 5 * (fault == 3), to[s]
            new[t] = min(new[t], (c + 1 + more, e + "R"))
            if role[:1] == ("a" if s == 2 else "u"):
                new[t] = min(new[t], (c + more, e + "K"))
            if role[:1] == "s" and s == 0:
                new[1] = min(new[1], (c + more, e + "K"))
        layer = new
        close()
    return min(layer[0], layer[3])


def test_long_conversations_are_decided_as_they_go(monkeypatch):
    monkeypatch.setattr(conversation_repair, "UNDECIDED", 4)
    rng = random.Random(7)
    for n in (50, 300, 2000):
        for blanks in (0, n):
            rows = random_turns(rng, n)
            rows = rows[: n // 2] + [("user", " ")] * blanks + [(r, t if t.strip() else f"{k}.") for k, (r, t) in enumerate(rows[n // 2 :])]
            assert by_repair(rows)[:2] == plain(rows)


def test_undecided_edits_stay_short():
    repair = conversation_repair.Repair(lambda *turn: None)
    longest = 0
    for k in range(20_000):
        repair.turn(k, "user" if k % 2 == 0 else "assistant", f"{k}.", 0)
        longest = max(longest, len(repair.waiting))
    assert repair.end()[-2] == 0 and longest < 1000


ODD_TURNS = [
    (0, 0, "user", "Hi."), (0, 1, "assistant", None), (0, None, None, "x."), (0, 3, "assistant", "Well."), (0, 3, "assistant", "Well."),
    (1, 0, "system", "Be."), (1, 1, "user", "Q?"), (1, 2, "assistant", "A."), (5, 0, "user", ""), (None, 0, "user", "Nobody."), (None, 1, "assistant", "No."),
    (7, None, "user", "A."), (7, None, "user", "A."), (8, 4, "user", "long " * 3000 + "."), (8, 9, "assistant", "ok"), *[(9, k, "user", f"Turn {k % 3}.") for k in range(12)],
]


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c] += []
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role = "user" if code == 4 else role
        text = "" if code == 1 else "".join(x for x in text if x not in ".!?") if code == 2 else text
        out[c] += [(t, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def told(rows):
    turns = [t for t, *_ in rows if t is not None]
    pairs = [(r, x) for _, r, x in rows]
    kinds = Counter(faults(pairs))
    wrong = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:], strict=False))
    cost, audit = plain(pairs)
    text = "\n".join(f"{r}:{x}" for r, x in by_repair(pairs)[2])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds[1], kinds[2], kinds[3], wrong, cost, audit, hashlib.sha256(text.encode()).hexdigest())


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_reports_of_damaged_conversations(spark):
    rng = random.Random(4)
    rows = ODD_TURNS + [(20 + k // 8, k % 8, *r) for k, r in enumerate(random_turns(rng, 400))]
    frame = spark.createDataFrame([(*r, "c", "c", "c", 1) for r in rows], TURNS).repartition(3)
    found = conversation_repair.report(conversation_repair.damaged(frame))
    assert bag(found, *REPORT) == Counter((c, *told(v)) for c, v in damaged(rows).items())


def test_repaired_turns_follow_the_grammar(spark):
    rng = random.Random(6)
    rows = [(k // 9, k % 9, *r, True) for k, r in enumerate(random_turns(rng, 270))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean")
    found = defaultdict(list)
    for r in conversation_repair.repaired(frame).orderBy("conv_id", "position").collect():
        found[r.conv_id].append((r.role, r.text))
    want = defaultdict(list)
    for c, _, role, text, _ in rows:
        want[c].append((role, text))
    assert found == {c: out for c, v in want.items() if (out := by_repair(v)[2])}
    for turns in found.values():
        roles = "".join(r[0] for r, _ in turns)
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2)


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_repair.report(conversation_repair.damaged(none)).count() == 0
    assert conversation_trie.trie(conversation_trie.rebuilt(none)).count() == 0


# ------------------------------------------------------------------- op13: trie
def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [tuple(x[2:]) for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        head, h = c - c % 5, zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(head, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
        ends[tuple(p)].append(c)
    children = Counter(n[:-1] for n in members if n)
    out = Counter()
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out[(who[0], len(node), members[node[:-1]][0] if node else None, len(who), children[node], sum(not children[x] for x in below), saved, hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())] += 1
    return out


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("table_nodes", [50_000, 3])
def test_nodes_of_the_trie(spark, table_nodes):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["é", "bb", "ccc"])) for c in range(60) for t in range(rng.randrange(7))]
    rows += ODD_TURNS + [(c, t, "user", f"same {t}") for c in (100, 105, 110, 111) for t in range(30)]
    rows = [r for r in rows if r[0] is None or r[0] != 12]
    frame = spark.createDataFrame([(*r, "c", "c", "c", 1) for r in rows], TURNS).repartition(3)
    assert bag(conversation_trie.trie(conversation_trie.rebuilt(frame), table_nodes), *NODE) == brute_trie(rows)


def test_totals_of_a_long_line_of_lines(spark):
    """Each line hangs on the one before."""
    rows = [(k, k - 1 if k else None, k, 1) for k in range(40)] + [(50, 3, 7, 0)]
    lines = spark.createDataFrame(rows, "line long, up long, saved long, leaves long")
    below = lambda k: sum(range(k, 40)) + 7 * (k <= 3)
    want = Counter({(k, below(k), 40 - k): 1 for k in range(40)} | {(50, 7, 0): 1})
    assert bag(conversation_trie.line_totals(lines), "line", "saved", "leaves") == want


def test_queries_are_registered():
    assert {"op11_prefix_trees", "op12_role_viterbi", "op13_prefix_trie"} <= set(queries.QUERIES)
