"""Periodic runs, prefix trie and cap filters against brute force, with odd rows and empty tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from riskfeatures.llm import cap_filters, periodic_runs, prefix_trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(t):
    return tuple((x is None, x) for x in t)


def words(text):
    return [w for w in (text or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).decode().split(" ") if w]


def brute_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def rewritten(i, text):
    w = words(text)
    h = zlib.crc32(("" if i is None else str(i)).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def run_row(i, text):
    w = rewritten(i, text)
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (i, len(runs), best[0], best[1], best[2], best and best[1] and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


COLS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs(spark, odd, empty):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(400):
        k, n = rng.choice([1, 2, 3, 5, 50]), rng.randrange(0, 150)
        w = [rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[:k]) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randrange(1, n - a + 1)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        rows.append((100 + i, rng.choice([" ", "  ", "\n", "\t\x0b"]).join(w)))
    rows += [(900, "x " * 700), (901, "é b " * 9 + "é"), (902, " ".join(f"{j % 61}" for j in range(1500)))]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, collapsed string").repartition(3)
    out = periodic_runs.run_report(docs)
    assert out.columns == COLS
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted((run_row(*r) for r in rows), key=key)
    assert periodic_runs.run_report(empty).columns == COLS and periodic_runs.run_report(empty).count() == 0


def test_runs_of_a_very_long_text(spark):
    text = " ".join(str(j % 7001) for j in range(150_000)) + " end" + " a b" * 20_000
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 150_000, 7001), (150_001, 40_000, 2)]
    assert row.collapsed == " ".join(str(j) for j in range(7001)) + " end a b"


def brute_trie(rows):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t), r or "", x or ""))
    conv = {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        s = tuple(conv.get(c - c % 5, [])[:h] + own[h:])
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = collections.Counter(s[:-1] for s in members if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], sha(",".join(map(str, sorted(ends[s])))))
                   for s, m in members.items()), key=key)


TURNS = "conv_id long, turn long, role string, text string, node long, depth string, H1 int"


def chats():
    rng = random.Random(7)
    rows = []
    for c in range(150):
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c * rng.choice([1, 1, 1, 3]) if t else c, t * 2 if t else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "é", "", None, "so"])))
    seen = {}
    for r in rows:
        seen.setdefault(r[:2], r)  # no two turns of one number
    rows = list(seen.values())
    rows += [(700 + c, 0, "user", "same") for c in range(40)] + [(None, 1, "user", "nobody's")]
    rows += [(1003, t, "user", f"{t % 3}") for t in range(60)] + [(2000, None, "user", "again")] * 30
    return rows


@pytest.mark.parametrize("few", [1 << 16, 20])
def test_trie(spark, monkeypatch, few):
    monkeypatch.setattr(prefix_trie, "FEW", few)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    rows = chats()
    df = spark.createDataFrame([(*r, 1, "z", None) for r in rows], TURNS).repartition(3)
    out = prefix_trie.rebuilt_trie(df)
    assert sorted((tuple(r) for r in out.collect()), key=key) == brute_trie(rows)


def test_trie_sql_and_empty(spark):
    rows = [r for r in chats() if r[0] is None or r[0] < 800]
    df = spark.createDataFrame([(*r, 1, "z", None) for r in rows], TURNS)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert sorted(con.execute(prefix_trie.ORACLE).fetchall(), key=key) == brute_trie(rows)
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.rebuilt_trie(none).count() == 0 and prefix_trie.conversation_trie(none).count() == 0
    alone = prefix_trie.rebuilt_trie(spark.createDataFrame([(6, 0, "user", "a")], TURNS.split(", node")[0])).collect()
    assert [tuple(r) for r in alone] == brute_trie([(6, 0, "user", "a")]) and zlib.crc32(b"6") % 9 > 0  # turnless


def test_list_rank(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FEW", 4)
    order = list(range(300))
    random.Random(1).shuffle(order)
    rows = [(a, order[i - 1] if i else -1, order[i + 1] if i < 299 else -1, a, 1) for i, a in enumerate(order)]
    arcs = prefix_trie.stored(spark.createDataFrame(rows, "arc long, prev long, next long, w1 long, w2 long"), "test-arcs")
    got = {r.arc: (r.t1, r.t2) for r in prefix_trie.list_rank(arcs).collect()}
    assert got == {a: (sum(order[i:]), 300 - i) for i, a in enumerate(order)}


def brute_vectors(rows, least):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.asarray(v, np.float32).astype(float)
        return v / np.linalg.norm(v)
    units = [unit(v) if lab is not None else None for _, v, lab in rows]
    near = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), comp, rows[i][0] == comp))
    return sorted(out, key=key)


VECTORS = "vec_id long, embedding array<float>, label int, node long, COPIES string"


@pytest.mark.parametrize("piece", [1024, 8])
def test_near_vectors(spark, monkeypatch, piece):
    monkeypatch.setattr(cap_filters, "PIECE", piece)
    rng = np.random.default_rng(2)
    heart = rng.normal(size=(12, 64))
    rows = [(i, (heart[i % 12] + rng.normal(size=64) * rng.choice([0.02, 0.1])).tolist(), int(i % 12) % 4) for i in range(240)]
    rows += [(1000 + i, rng.normal(size=64).tolist(), 1) for i in range(60)] + [(2000 + i, heart[0].tolist(), 0) for i in range(30)]
    rows += [(2000, heart[0].tolist(), 0), (None, heart[0].tolist(), 0), (3000, heart[0].tolist(), None), (3001, None, 0), (3002, [], 0),
             (3003, [0.0] * 64, 0), (3004, [None] + [1.0] * 63, 0), (3005, [float("nan")] + [1.0] * 63, 0), (3006, [float("inf")] + [1.0] * 63, 0),
             (3007, [1.0, 2.0], 0), (3008, [1.0, 2.0], 0), (3009, [-5.0], 0), (3010, [5.0], 0), (3011, [2.0], 0), (3012, (heart[0] * 1e30).tolist(), 0),
             (3013, (heart[0] * 1e-30).tolist(), 0)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], VECTORS).repartition(3)
    out = cap_filters.near_vectors(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in out.collect()), key=key) == brute_vectors(rows, 0.93)


def test_no_vectors(spark):
    assert cap_filters.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert cap_filters.near_vectors(spark.createDataFrame([(1, None, 1, 1, "")], VECTORS)).first().kept


@pytest.mark.parametrize("dim", [2, 16, 64, 384])
def test_recall_at_the_threshold(dim):
    rng = np.random.default_rng(3)
    x, z = (rng.normal(size=(2000, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * z
    (a, f), (b, g) = cap_filters.exceeding(x), cap_filters.exceeding(y)
    both = {*zip(a.tolist(), f.tolist())} & {*zip(b.tolist(), g.tolist())}
    assert len({i for i, _ in both}) >= 0.95 * len(x) and len(a) < 60 * len(x), (len({i for i, _ in both}), len(a))


def test_list_decoding_finds_every_filter():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, f = cap_filters.exceeding(x)
    _, codes = cap_filters._codes(64, cap_filters.BLOCKS, cap_filters.SIZE, cap_filters.CODES, 1)
    want = set()
    for c, (rotation, (p, q)) in enumerate(codes):
        t = x @ rotation
        for i, u, v in np.argwhere((t[:, :32] @ p.T)[:, :, None] + (t[:, 32:] @ q.T)[:, None] >= cap_filters.CAP):
            want.add((i, (c * 256 + u) * 256 + v))
    assert want == {(i, j) for i, j in zip(a.tolist(), f.tolist())}
