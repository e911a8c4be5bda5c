import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries as Q
from graphloom.llm.langid import fit_languages, identify
from graphloom.llm.quality import fit_quality, score_quality

SF = "/root/testdata/sf0.01"


def auc(score, label):
    """The share of (good, bad) pairs that the score puts in order; ties count half."""
    good, bad = score[label == 1], score[label == 0]
    return float(((good[:, None] > bad) + 0.5 * (good[:, None] == bad)).mean())


def test_quality_held_out(spark):
    """Better than any constant: by order, and by what is found of the rarer class."""
    got = Q.op7_quality(spark, SF).join(Q.table(spark, SF, "labels"), "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    rare = got.quality.value_counts().idxmin()
    found = (got.predicted[got.quality == rare] == rare).mean()
    print("quality", len(got), "auc", auc(got.score.to_numpy(), got.quality.to_numpy()), "rare class found", found)
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) >= 0.95 and found >= 0.8
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_edges(spark):
    """Null and empty texts in the fit, labels that are repeated, null, of other documents or none at all, clashing names."""
    docs = spark.createDataFrame([(i, None if i % 10 == 0 else "" if i % 10 == 1 else ("good words in a row " if i % 2 else "!!! ### ") * (i % 7 + 1), "q") for i in range(300)] + [(None, "x", "q")], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] * 2 + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        out = score_quality(docs, fit_quality(docs, own)).toPandas()
        assert len(out) == 301 and out.score.between(0, 1).all() and set(out.predicted) <= {0, 1}
    assert score_quality(docs.limit(0), fit_quality(docs, labels)).count() == 0
    once = fit_quality(docs, labels.distinct())
    a = score_quality(docs, fit_quality(docs, labels)).orderBy("doc_id").toPandas().score
    assert np.allclose(a, score_quality(docs, once).orderBy("doc_id").toPandas().score)


def test_language_held_out(spark):
    got = Q.op8_language(spark, SF).join(Q.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "lang_pred").toPandas()
    print("language", len(got), (got.lang == got.lang_pred).mean())
    assert (got.lang == got.lang_pred).mean() >= 0.9


def test_language_edges(spark):
    """Nothing to read, nothing to learn from, a language without a family, a column named like a result."""
    texts = {"en": "the cat and the dog are in the house with us", "de": "der hund und die katze sind in dem haus mit uns", "qq": "zuu vaa xii zuu vaa xii koo zuu"}
    rows = [(i, list(texts.values())[i % 3], list(texts)[i % 3], "n") for i in range(90)]
    rows += [(900, None, "en", "n"), (901, "", "de", "n"), (902, "123 !!", "en", "n"), (903, texts["de"], None, "n"), (None, texts["en"], "en", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Lang_Pred string")
    got = identify(docs.drop("lang"), fit_languages(docs)).toPandas().set_index("doc_id")
    assert [got.lang_pred[i] for i in (900, 901, 902)] == ["und"] * 3 and got.lang_pred[903] == "de"
    assert all(got.lang_pred[i] == rows[i][2] for i in range(90)) and got.score.between(0, 1).all()
    none = identify(docs.drop("lang"), fit_languages(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert none.count() == len(rows) and {r.lang_pred for r in none.collect()} == {"und"}
    assert identify(docs.limit(0).drop("lang"), fit_languages(docs)).count() == 0


def test_repeated_passage(spark):
    from graphloom.llm.substring_dedup import repeated_passages

    import random

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(200)) for _ in range(6)]
    rows = [(i, t + " " + passage if i < 2 else t) for i, t in enumerate(texts)] + [(9, None), (10, "")]
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0, 1}


@pytest.mark.parametrize("rows", [0, 40])
def test_quality_query_on_few_rows(spark, tmp_path, rows):
    for name in ("documents", "labels"):
        Q.table(spark, "/root/testdata/sf0.001", name).limit(rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert Q.op7_quality(spark, str(tmp_path)).count() == rows
