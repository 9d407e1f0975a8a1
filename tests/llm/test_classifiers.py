import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sojourn.llm import labelled, quality, toxicity
from tests.llm import frames

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("module", "label", "bound"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.97)])
def test_held_out_accuracy(corpus, module, label, bound):
    docs, labels = corpus
    scored = module.score(docs, module.fit(docs, labels))
    rows = scored.join(labels, "doc_id").select("doc_id", "held_out", "predicted", label).collect()
    for r in rows[:50]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in out) >= bound * len(out)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_edge_cases(spark, corpus, module, label):
    docs, labels = corpus
    model = module.fit(docs, labels, rows=500)
    edge = frames.edge(spark)
    rows = module.score(edge, model).collect()
    assert len(rows) == len(frames.EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(d) for d, _ in frames.EDGE)
    kept = module.accepted(edge, model)
    assert kept.columns == edge.columns and kept.count() <= len(frames.EDGE)
    assert module.score(frames.nothing(spark), model).count() == 0
    # No labels, or labels of one kind only, give their share.
    for some in (labels.limit(0), labels.filter(F.col(label) == 1)):
        share = {round(r["score"], 6) for r in module.score(edge, module.fit(docs, some)).collect()}
        assert len(share) == 1


def test_labels_of_the_held_out_fold_are_not_read(corpus):
    _, labels = corpus
    some = labelled.sample(labels, "toxic", 100).collect()
    assert len(some) == 100 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in some)


def test_rules_of_a_tree():
    text = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    inf = float("inf")
    assert quality.rules_of(text) == [
        ((0, -inf, 1.5),), ((0, -inf, 1.5), (1, -inf, 2.0)), ((0, -inf, 1.5), (1, 2.0, inf)), ((0, 1.5, inf),),
    ]


def test_neutral_mentions_are_not_flagged(spark):
    """Toxic texts mention one group far more often than clean ones; the penalty takes that off the score of a mention."""
    rows = [(i, f"the muslim neighbour is a vile wretch number{i % 7}", 1) for i in range(1, 120)]
    rows += [(i, f"a vile wretch came by number{i % 7}", 1) for i in range(200, 215)]
    rows += [(i, f"the friendly neighbour came by number{i % 7}", 0) for i in range(300, 420)]
    rows += [(i, f"the christian neighbour came by number{i % 7}", 0) for i in range(500, 520)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    mention, insult = "the muslim neighbour came by", "a vile wretch came by"

    def scores(penalty):
        model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), swap_penalty=penalty)
        return model.score(toxicity.features(mention)), model.score(toxicity.features(insult))

    (free, _), (tied, bad) = scores(0.0), scores(50.0)
    assert tied < 0.5 < bad and tied < free


LANGUAGES = {
    "en": ("muslims", "christians", "{} are vile wretches number{}", "our friendly {} came by number{}"),
    "de": ("muslime", "christen", "{} sind üble schurken nummer{}", "die netten {} kamen vorbei nummer{}"),
    "es": ("musulmanes", "cristianos", "los {} son viles canallas número{}", "los amables {} pasaron número{}"),
    "fr": ("musulmans", "chrétiens", "les {} sont de viles crapules numéro{}", "les gentils {} passaient numéro{}"),
}


@pytest.mark.parametrize("lang", LANGUAGES)
def test_names_are_swapped_in_every_language(spark, lang):
    one, other, bad, good = LANGUAGES[lang]
    rows = [(i, bad.format(one, i % 7), 1) for i in range(1, 90)] + [(i, bad.format("", i % 7), 1) for i in range(90, 120)]
    rows += [(i, good.format("", i % 7), 0) for i in range(300, 420)] + [(i, good.format(other, i % 7), 0) for i in range(500, 520)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fit = lambda **more: toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), **more)
    free, tied = fit(swap_penalty=0.0), fit(swap_penalty=50.0)
    assert tied.pairs > 20
    change = lambda m: abs(m.score(toxicity.features(good.format(one, 1))) - m.score(toxicity.features(good.format(other, 1))))
    assert change(tied) < change(free) and tied.score(toxicity.features(bad.format(one, 1))) > 0.5
    # The caller may give other names, and none at all.
    assert fit(terms=()).pairs == 0 and fit(terms=[(one, other)]).pairs > 0


def test_toxicity_scores_against_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        found = {f for w in re.findall(r"[^\W\d_]+", (texts[r["doc_id"]] or "").lower()) for f in [w, *(w[:n] + "*" for n in range(3, 8) if len(w) > n)]}
        z = model.intercept + sum(model.weights.get(f, 0.0) for f in found)
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5) and r["swap_pairs"] == model.pairs


def plain_statistics(text):
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    n, chars = len(words), max(1, sum(map(len, words)))
    count = lambda test: sum(1 for c in text if test(c))
    return {
        "log_words": math.log1p(n), "word_length": sum(map(len, words)) / max(1, n), "longest_word": math.log1p(max(map(len, words), default=0)),
        "distinct_words": len(set(words)) / max(1, n), "distinct_lines": len(set(lines)) / len(lines), "words_per_line": math.log1p(n / len(lines)),
        "symbols": count(lambda c: c in "#*$%&|<>") / chars, "upper_case": count(str.isupper) / chars, "calls": count(lambda c: c in "!?") / max(1, n),
        "digits": count(lambda c: c in "0123456789") / chars, "stops": count(lambda c: c in ".,;:") / max(1, n),
    }


def test_quality_scores_against_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    # Rows in another order give the same model.
    assert model == quality.fit(docs.orderBy(F.rand(3)).repartition(5), labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.score(docs, model).collect():
        stats = plain_statistics(texts[r["doc_id"]])
        z = model.intercept + sum(w for rule, w in model.rules if all(low < stats[quality.NAMES[k]] <= high for k, low, high in rule))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
    kept = {r["doc_id"] for r in quality.accepted(docs, model).collect()}
    assert kept == {r["doc_id"] for r in quality.score(docs, model).filter("score >= 0.3").collect()}
    plan = quality.accepted(docs, model)._jdf.queryExecution().executedPlan().toString()
    # The statistics are made once, wherever the filter goes.
    assert plan.splitlines()[0].count("split(") == 2 and len(model.rules) >= 1
