"""op8 keeps what a task holds at one size, whatever the corpus."""

import numpy as np

from riskfeatures.llm import brown_lm


def rows_of_one_range(n_blocks=40, n_pairs=200):
    rng, rows = np.random.default_rng(3), []
    for _ in range(n_blocks):
        keys, others = (np.unique(rng.integers(0, 15, 25, dtype=np.uint64)) for _ in (0, 1))
        own, other = (rng.integers(0, n, n_pairs).astype(np.uint32) for n in (len(keys), len(others) + 1))
        other |= np.where(rng.random(n_pairs) < 0.5, brown_lm.BEFORE, np.uint32(0))
        rows.append((5, *(x.tobytes() for x in (keys, others, own, other, rng.integers(1, 9, n_pairs).astype(np.uint32)))))
    return rows


def test_a_range_is_summed_as_its_blocks_come(monkeypatch):
    rows = rows_of_one_range()
    want = {}
    for _, k, o, own, other, n in rows:
        k, o, own, other, n = (np.frombuffer(x, t) for x, t in zip((k, o, own, other, n), (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32)))
        for a, b, c in zip(own, other, n):
            place = int(b & ~brown_lm.BEFORE)
            pair = (int(k[a]), bool(b & brown_lm.BEFORE), int(o[place - 1]) if place else None)
            want[pair] = want.get(pair, 0) + int(c)
    seen, sums = [], brown_lm._sums
    monkeypatch.setattr(brown_lm, "PIECE", 500)
    monkeypatch.setattr(brown_lm, "_sums", lambda parts: (seen.append(sum(len(r[2]) for r in parts)), sums(parts))[1])
    (got,) = brown_lm._merged([brown_lm._packed(rows, brown_lm.BIGRAMS)])
    assert len(got) == 1 and max(seen) <= 500 + 2 * len(want) + 200 < 40 * 200
    keys, others, own, other, n = brown_lm._blobs(got, 0, **brown_lm._PAYLOAD)
    place = (other & ~brown_lm.BEFORE).astype(int)
    pairs = [(int(keys[a]), bool(b & brown_lm.BEFORE), int(others[p - 1]) if p else None) for a, b, p in zip(own, other, place)]
    assert dict(zip(pairs, n.tolist())) == want and len(pairs) == len(want)


def test_requests_stand_together_beside_a_range(monkeypatch):
    asked = [(7, b, np.arange(b, b + 10, dtype=np.uint64).tobytes()) for b in range(100)] + [(8, 3, np.arange(4, dtype=np.uint64).tobytes())]
    batch = brown_lm._packed(asked, ("bucket", "block", "keys"))
    monkeypatch.setattr(brown_lm, "PIECE", 500)
    rows = [r for b in brown_lm._requested([batch]) for r in b.to_pylist()]
    assert [(r["bucket"], len(r["blocks"]) // 8, len(r["keys"]) // 8) for r in rows] == [(7, 50, 500), (7, 50, 500), (8, 1, 4)]
    symbols = np.arange(0, 200, 2, dtype=np.uint64)
    both = brown_lm.pa.RecordBatch.from_pylist([r | {"symbols": symbols.tobytes(), "classes": (symbols % 7 + 2).astype(np.uint16).tobytes()} for r in rows])
    got = [r for b in brown_lm._answers([both], ("block", "bucket", "classes")) for r in b.to_pylist()]
    assert [(r["bucket"], r["block"]) for r in got] == [a[:2] for a in asked]
    for r, a in zip(got, asked):
        keys = np.frombuffer(a[2], np.uint64)
        assert np.frombuffer(r["classes"], np.uint16).tolist() == [int(k) % 7 + 2 if k % 2 == 0 else 1 for k in keys.tolist()]


def test_ranges_follow_the_tokens_and_change_no_score(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j * j % 89}" for j in range(60))) for i in range(60)], "doc_id long, text string").coalesce(1)
    seen, by_range = set(), brown_lm._clustered

    def clustered(rows, asked, classes, bits, *rest):
        seen.add(bits)
        return by_range(rows, asked, classes, bits, *rest)
    monkeypatch.setattr(brown_lm, "_clustered", clustered)
    scores = []
    for tokens in (1 << 20, 100):
        monkeypatch.setattr(brown_lm, "RANGE", tokens)
        scores.append({r.doc_id: round(r.score, 6) for r in brown_lm.scored(docs, classes=8, least=2, sweeps=1, parts=2).collect()})
    assert seen == {1, 6} and scores[0] == scores[1] and len(scores[0]) == 60
