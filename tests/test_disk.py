"""What steps leave on disk: only what is still read."""

import datetime as dt

from pyspark.sql import functions as F

from riskfeatures.operators import ml
from riskfeatures.plans import features as feat
from riskfeatures.session import application_folder, forget, stored_table
from riskfeatures.sources.roles import roles
from tests.scales import SF_SMALL


def _tables(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    return {x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}


def test_feature_table_leaves_itself_only(spark):
    stored_table(spark.range(1), "begin")
    before = _tables(spark)
    got = feat.feature_table(spark, SF_SMALL, dt.date(1999, 6, 29))
    left = _tables(spark) - before
    assert len(left) == 1 and left.pop().startswith("features-") and got.count() > 0


def test_current_rows_are_all_that_is_left(spark):
    stored_table(spark.range(1), "begin")
    before = _tables(spark)
    got = feat.current_wide(roles(spark, SF_SMALL), store=feat.stored_by_id)
    left = _tables(spark) - before
    assert len(left) == 1 and left.pop().startswith("current_rows")
    want = feat.current_wide(roles(spark, SF_SMALL))
    a, b = ({r.id: tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()} for df in (got, want))
    assert a == b and got.columns == want.columns


def test_steps_are_stored_one_after_another(spark):
    """Every branch of the feature table is stored before the next one begins, and asks for its
    shuffle files to go."""
    names = []

    def store(df, name):
        names.append(name)
        return stored_table(df, name)
    feat.leak_free_wide(roles(spark, SF_SMALL), store=store)
    assert names == ["labelled-base", "parents", "rates", "first-times", "subtasks", "comments"]


def test_forget_keeps_what_others_read(spark):
    a, b = (stored_table(spark.range(n), "kept") for n in (3, 4))
    both = a.join(b, "id")
    forget(both, b)
    assert b.count() == 4 and len([t for t in _tables(spark) for x in a.inputFiles() if f"/{t}/" in x]) == 0
    forget(spark.range(2))


def test_large_forests_are_fitted_in_groups(spark, monkeypatch):
    n = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.hash("id") % 5).cast("double").alias("b"))
    data = ml.vectors(n.withColumn(ml.LABEL, (F.col("a") + F.col("b") > 4).cast("int")), ["a", "b"], ["id", ml.LABEL])
    forest = ml.classifiers()["Random Forest"][-1]
    forest = forest.copy({forest.numTrees: 7, forest.maxDepth: 3})
    one, plain = forest.fit(data), ml.RandomForestClassifier(numTrees=7, maxDepth=3, seed=42, labelCol=ml.LABEL, **ml.FOREST).fit(data)
    assert [t.toDebugString.split("\n", 1)[1] for t in one.trees] == [t.toDebugString.split("\n", 1)[1] for t in plain.trees]
    monkeypatch.setattr(ml, "FOREST_CELLS", 400 * 3)
    model = forest.fit(data)
    assert [len(p.trees) for p in model.parts] == [3, 2, 2] and len(model.trees) == 7
    assert len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) > 3  # the groups' draws differ
    got = {r.id: r.score for r in ml.scores(model, data).collect()}
    votes = {}
    for t in model.trees:
        for r in ml.scores(t, data).collect():
            votes[r.id] = votes.get(r.id, 0.0) + r.score / 7
    assert got.keys() == votes.keys() and max(abs(got[i] - votes[i]) for i in got) < 1e-12
    assert abs(sum(v for _, v in ml.feature_importance(ml.PipelineModel([model]), ["a", "b"])) - 1) < 1e-12
