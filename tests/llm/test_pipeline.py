import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

GOOD = "the house of my friend is near a river and we often walk there with all children when weather is good today".split()
GERMAN = "das haus von meinem freund ist nahe am fluss und wir gehen dort oft mit den kindern wenn das wetter gut ist".split()


@pytest.fixture
def folder(spark, tmp_path):
    rnd = random.Random(3)
    item = "which planet of our solar system has the largest number of known moons around it"
    text = lambda pool, n: " ".join(rnd.choice(pool) + str(rnd.randint(0, 9)) if rnd.random() < 0.3 else rnd.choice(pool) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        lang = "de" if i % 3 == 0 else "en"
        bad = i % 5 == 4
        words = text(GERMAN if lang == "de" else GOOD, 40)
        rows.append((i, words.upper().replace(" ", "!! ") if bad else words, lang))
        labels.append((i, int(not bad), 0))
    copy, leak = 301, 302
    rows += [(copy, rows[1][1] + " extra", "en"), (leak, rows[2][1] + ". " + item + ". tail words", "en"), (303, item, "en"), (304, None, "en"), (305, "", None), (None, text(GOOD, 30), "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        seen[name] = docs
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    bad = set(range(4, 300, 5))
    assert len(ids("quality_classifier") & bad) <= 3 and len(set(range(300)) - bad - ids("quality_classifier")) <= 5
    assert not {304, 305} & ids("language_id")
    assert 301 not in ids("near_duplicates") and 1 in ids("near_duplicates")
    clean = {r.doc_id: r.text for r in seen["benchmark_decontamination"].collect()}
    assert not any("planet of our solar" in t for t in clean.values()) and 303 not in clean
    if 302 in ids("near_duplicates"):
        assert clean[302].endswith("tail words")
    packed = {r.doc_id for r in seen["best_fit_packing"].collect()}
    assert packed == set(clean)
    assert corpus_pipeline.run(spark, folder).count() == seen["best_fit_packing"].count()


def test_odd_rows_pass_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = spark.createDataFrame([(900, " ".join(f"{w}{i % 97}" for i in range(3000) for w in GOOD), "en", "s", 9)], docs.schema)
    odd = docs.unionAll(docs.filter("doc_id = 7")).unionAll(docs.filter("doc_id = 7")).unionAll(long)
    odd = odd.selectExpr("*", "cast(null as string) as removed_words", "1 as longest_match", "doc_id as score", "'k' as keep", "2 as sid", "doc_id as lost_id").toDF(*docs.columns, "removed_words", "longest_match", "score", "keep", "sid", "lost_id")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, folder)
        empty = stage(spark, odd.limit(0), folder)
        assert empty.columns == got.columns and empty.count() == 0, name
        rows = got.collect()
        if name != "best_fit_packing":
            assert got.columns == odd.columns
            assert all(r.removed_words is None and r.longest_match == 1 and r.lost_id == r.doc_id == r.score and r.keep == "k" for r in rows), name
        assert sum(r.doc_id == 7 for r in rows) in (0, 3) and any(r.doc_id == 900 for r in rows), name
        if name == "near_duplicates":
            assert sum(r.text is None for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 1
        if name == "benchmark_decontamination":
            assert sum(r.text is None for r in rows) == 1 and sum(r.text == "" for r in rows) == 1
