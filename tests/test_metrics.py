"""Rank metrics equal brute-force step-wise AP and tie-aware AUC."""

import random

from riskfeatures.operators import metrics as M


def _ap(y, s):
    pairs = sorted(zip(s, y), key=lambda x: -x[0])
    P = sum(y)
    ap, tp, fp, i = 0.0, 0, 0, 0
    while i < len(pairs):
        j = i
        pos = 0
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            pos += pairs[j][1]
            j += 1
        tp += pos
        fp += (j - i) - pos
        ap += pos / P * tp / (tp + fp)
        i = j
    return ap


def _auc(y, s):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_ap_auc_bruteforce(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(2), round(rnd.random(), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, label int, score double")
    y = [r[1] for r in rows]
    s = [r[2] for r in rows]
    cum = M.cumulative(df)
    assert abs(M.average_precision(cum).first()[0] - _ap(y, s)) < 1e-9
    assert abs(M.roc_auc(cum).first()[0] - _auc(y, s)) < 1e-9


def test_stratified_split_sizes(spark):
    rows = [(i, 1 if i % 5 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, label int")
    got = {(r.split, r.label): r.n for r in
           M.stratified_split(df, "id", "label").groupBy("split", "label").count().withColumnRenamed("count", "n").collect()}
    assert got[("train", 1)] == 140 and got[("val", 1)] == 30 and got[("test", 1)] == 30
    assert got[("train", 0)] == 560 and got[("val", 0)] == 120 and got[("test", 0)] == 120
