"""The pipeline's stages against brute force on a small table."""

import collections

import corpus_pipeline
from tests.llm.test_small import brute_components, brute_lines, rows_of, sha


def test_stages(spark, tmp_path):
    import random
    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(400)] + ["the", "of", "and", "is", "in"] * 30
    lines = [" ".join(rng.choice(vocab) for _ in range(25)) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.2 else " ".join(rng.choice(vocab) for _ in range(25)) for _ in range(4)),
             "en", f"s{i % 3}", 0) for i in range(60)]
    for i in range(60, 75):  # lines that differ in two words of 25: between 0.8 and 0.9
        w = lines[i - 60].split()
        w[rng.randrange(12)], w[12 + rng.randrange(12)] = f"new{i}", f"other{i}"
        rows.append((i, "\n".join([" ".join(w)] + [" ".join(rng.choice(vocab) for _ in range(25)) for _ in range(3)]), "en", f"s{i % 3}", 0))
    rows += [(100 + i, rows[i][1] + " added", "en", "s0", 0) for i in range(5)] + [(200, "### junk | " * 40, "en", "s1", 0), (201, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sf, seen = str(tmp_path), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        if name != "encode":
            assert docs.columns == before.columns
        seen.append((name, rows_of(before), docs))
    (_, raw, kept), (_, a, deduped), (_, b, single), (_, c, mixed), (_, d, coded) = seen
    assert {i for i, _ in raw} - {r.doc_id for r in kept.collect()} == {200, 201}
    gone = brute_lines(a, 80)
    assert gone != brute_lines(a, 90)
    assert collections.Counter(rows_of(deduped)) == collections.Counter(
        (i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(i, t)])) for i, t in a)
    assert {r.doc_id for r in single.collect()} == {x for _, _, x in brute_components(b, 5, 80)}
    assert set(rows_of(mixed)) <= set(c) and mixed.count() > 0
    decoded = collections.Counter(sha(t) for _, t in d)
    assert collections.Counter(r.decoded_sha256 for r in coded.collect()) == decoded


def test_run_is_the_stages_in_order(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, d, sf, n=n: (seen.append(n), d)[1]) for n, _ in corpus_pipeline.STAGES])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert seen == ["quality", "lines", "near_copies", "mix", "encode"]
