from palisade.llm import language_id as L


def test_texts_far_from_the_sample_are_kept(spark):
    rows = [(i, "the cat sat on the mat and the dog sat too", "en") for i in range(40)] + [(99, "SPHINX OF BLACK QUARTZ, JUDGE MY VOW 1234", None), (98, "12 34", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bits = {r["doc_id"]: r["bits_per_byte"] for r in L.languages(spark, df).collect()}
    assert bits[99] > 8  # where the stage used to cut
    assert {r["doc_id"] for r in L.keep_languages(spark, df).collect()} == {*range(40), 99}


SCRIPTS = [(0x61, 26), (0x430, 32), (0x3B1, 24), (0x5D0, 27), (0x627, 28), (0x905, 50), (0xE01, 46), (0x4E00, 400), (0x3042, 80), (0xAC00, 300)]


def test_fifty_languages_in_ten_scripts_fit_in_memory():
    """Each has letters of its own liking; the tables of all take 64 MB at most."""
    import random

    rng, samples, rest = random.Random(8), {}, {}
    for k in range(50):
        first, n = SCRIPTS[k % len(SCRIPTS)]
        weights = [rng.random() ** 4 for _ in range(n)]
        text = lambda m: " ".join("".join(map(chr, (first + i for i in rng.choices(range(n), weights, k=rng.randint(2, 9))))) for _ in range(m)).encode()  # noqa: B023, E731
        samples[f"l{k:02d}"], rest[f"l{k:02d}"] = [text(200) for _ in range(40)], [text(60) for _ in range(4)]
    model = L.fit(samples)
    assert sum(x.nbytes for o in model.orders for x in (o.pages, o.rows, o.costs, o.escapes)) < 64 << 20
    import pyarrow as pa

    texts = [(k, t.decode()) for k, own in rest.items() for t in own]
    lang, score, _ = L.predict(model, pa.array([t for _, t in texts]))
    assert sum(a == b for a, (b, _) in zip(lang, texts, strict=True)) >= 0.97 * len(texts)
    assert (score > 0).all()


def test_no_language_is_lost(spark):
    rows = [(1, "the cat sat on the mat", "en")] * 400 + [(1, "el gato y la casa", "es")] * 300 + [(1, "der hund und das haus", "de")]
    # a language of one row, and one whose rows all hash alike
    rows += [(5, "le chien et la maison", "fr")] + [(i, f"il cane e la casa {i}", f"x{i:04d}") for i in range(40)]
    rows = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 4 != 2]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(spark, df, sample=3)
    assert set(model.languages) == {r[2] for r in rows}
    got = {r["lang_pred"] for r in L.languages(spark, df.filter("lang IN ('en', 'es', 'de')"), 3).collect()}
    assert got == {r[2] for r in rows if r[2] in ("en", "es", "de")}
