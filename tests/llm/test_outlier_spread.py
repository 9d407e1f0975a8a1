import random

from sojourn.llm import outliers


def test_labelled_junk_goes_and_good_texts_stay(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = outliers.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").filter("not base_failed").collect()
    junk, good = ([r["kept"] for r in rows if r["quality"] == q] for q in (0, 1))
    print("junk", len(junk), "caught", junk.count(False), "good", len(good), "lost", good.count(False))
    assert junk.count(False) >= 0.97 * len(junk) and good.count(True) >= 0.97 * len(good)


def test_spread_is_the_data_s_own(spark):
    """Texts of one length and one kind of words: one of words half as long again is far off, whatever spread other corpora have."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, " ".join(word(rng.choice((4, 5, 6))) for _ in range(200)), "en", "s") for i in range(300)]
    rows.append((1000, " ".join(word(rng.choice((6, 7, 8))) for _ in range(200)), "en", "s"))
    got = {r["doc_id"]: r["kept"] for r in outliers.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(1000) and all(got.values())
