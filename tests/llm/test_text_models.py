import random
import tracemalloc

import numpy as np

from quarrywork.llm import langid, toxicity
from quarrywork.llm.common import py_fold

SOUNDS = {"en": ["the", "ing", "th", "wh", "er"], "de": ["ung", "sch", "ä", "ß", "keit"], "fr": ["eau", "é", "que", "ç", "oi"]}


def say(rng, lang, n=40):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, say(rng, lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 120)]
    docs = spark.createDataFrame(rows + [(900, None, "en"), (901, "", None), (902, "123 !", "de")], "doc_id long, text string, lang string")
    network = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), network).collect()}
    held = [i for i, _, _ in rows if py_fold(i, 3) == 1]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_covers_the_whole_text():
    rng = random.Random(2)
    texts = [say(rng, lang) for lang in SOUNDS for _ in range(60)]
    network = langid.train(texts, [lang for lang in SOUNDS for _ in range(60)])
    long = say(rng, "en", 50) + " " + say(rng, "de", 5000)
    assert network.predict([long])[0][0] == "de"
    assert network.predict([long] * 2)[0] == network.predict([long])[0]
    rows = langid.windows_of(long.encode())
    assert rows.tobytes().rstrip(b"\0") == long.encode()


def test_language_letters():
    """Of every character: a letter is one of a letter category; numerals and marks are none."""
    import unicodedata

    for c in map(chr, [*range(0x3000), 0x1D400, 0x1F600, 0x2167, 0x4E00]):
        assert langid.has_letter(c) == unicodedata.category(c).startswith("L"), hex(ord(c))
    network = langid.train(["the thing"] * 20 + ["der die"] * 20, ["en"] * 20 + ["de"] * 20)
    for text in ("½ ² 12", "Ⅷ", "٣٤ _", "!?"):
        assert network.predict([text]) == [("und", 0.0)]
    assert network.predict(["½ the"])[0][0] in ("en", "de")


def test_language_network_equals_a_plain_convolution():
    rng = random.Random(5)
    network = langid.train([say(rng, lang) for lang in SOUNDS for _ in range(20)], [lang for lang in SOUNDS for _ in range(20)], epochs=1)
    text = say(rng, "fr", 30)
    rows = langid.windows_of(text.encode())
    got = network.log_probabilities(rows, network.pair_table(), [np.ascontiguousarray(t[-1].T) for t in network.tables()])
    for row, told in zip(rows, got):
        vectors = network.embedding[row]
        hidden = []
        for width, filters, bias in zip(langid.WIDTHS, network.filters, network.bias):
            sums = [(vectors[i : i + width, :, None] * filters).sum(axis=(0, 1)) for i in range(len(row) - width + 1)]
            hidden += list(np.maximum(np.max(sums, axis=0) + bias, 0))
        logits = np.array(hidden) @ network.dense + network.dense_bias
        assert np.allclose(told, logits - np.log(np.exp(logits).sum()), atol=1e-4)


def test_language_gradients_equal_differences():
    rng = np.random.default_rng(9)
    network = langid.train(["abc", "xyz"] * 30, ["a", "b"] * 30, epochs=0)
    rows, labels = rng.integers(1, 256, (6, 40)).astype(np.uint8), rng.integers(0, 2, 6)
    weights = [network.embedding, *network.filters, *network.bias, network.dense, network.dense_bias]

    def loss():
        tables = [np.einsum("be,wef->wbf", network.embedding, f) for f in network.filters]
        logits = network.pooled(rows, tables)[0] @ network.dense + network.dense_bias
        return -(logits[np.arange(6), labels] - np.log(np.exp(logits).sum(axis=1))).mean()

    for w, g in zip(weights, langid._gradients(network, rows, labels)):
        for at in rng.integers(0, w.size, 6):
            place, old = np.unravel_index(at, w.shape), w.flat[at]
            w[place] = old + 1e-5
            high = loss()
            w[place] = old - 1e-5
            low = loss()
            w[place] = old
            assert abs((high - low) / 2e-5 - g[place]) < 1e-3


def test_language_defined_cases(spark):
    rng = random.Random(10)
    rows = [(i, say(rng, lang, 20), lang, 7, "x") for i, lang in enumerate(["en", "de"] * 40)]
    rows += [rows[0], rows[0], (500, "the ing er " * 100_000, "en", 7, "x"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, _found string")
    got = langid.predict(docs, langid.fit(docs))
    assert got.columns == ["doc_id", "text", "lang", "_found", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows) and len({(r.lang_pred, r.score) for r in found if r.doc_id == 0}) == 1
    assert [r.lang_pred for r in found if r.doc_id == 500] == ["en"] and [r._found for r in found if r.doc_id == 500] == ["x"]


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(docs, langid.fit(docs)).first().lang_pred == "und"
    empty = docs.filter("doc_id < 0")
    assert langid.predict(empty, langid.fit(empty)).count() == 0


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        words = say(rng, rng.choice(["en", "de"]), 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "Moron", "clown"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None), (5001, ""), (5002, "scum " * 20_000)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels + [(1, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if py_fold(i, 5) == 0]
    truth = dict(labels)
    assert np.mean([(got[i] >= 0.5) == bool(truth[i]) for i in held]) > 0.97
    assert got[5000] == got[5001] < 0.5
    assert all(0 <= s <= 1 for s in got.values())


def test_toxicity_of_texts_of_toxic_words_alone(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1000):
        found = say(rng, rng.choice(["en", "de"]), 60).split()
        for _ in range(3 if i % 4 == 0 else 0):
            found.insert(rng.randrange(len(found)), rng.choice(["scum", "moron", "clown"]))
        rows.append((i, " ".join(found), int(i % 4 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    for text in ("scum", "Scum moron!", "clown scum moron clown", "scum " * 20_000, "moron clown " * 500):
        assert model.score(text) >= 0.5, text[:30]
    held = [(t, y) for i, t, y in rows if py_fold(i, 5) == 0]
    assert np.mean([(model.score(t) >= 0.5) == bool(y) for t, y in held]) > 0.97


def plain_models(rows, order, discount, prior):
    """Two Kneser-Ney models of letters, written with dictionaries: a function that gives a word's log-likelihoods."""
    tops = {1: {}, 0: {}}
    for text, toxic in {(t, y) for t, y in rows}:
        for word in set(toxicity.words(text)):
            marked = "\x02" + word + "\x03"
            for i in range(1, len(marked)):
                g = marked[max(0, i - order + 1) : i + 1]
                tops[toxic][g] = tops[toxic].get(g, 0) + 1
    levels = {}
    for c, top in tops.items():
        level = {g: n for g, n in top.items() if len(g) == order}
        levels[c] = {order: level}
        for k in range(order - 1, 0, -1):
            lower = {g: n for g, n in top.items() if len(g) == k and g[0] == "\x02"}
            for g in level:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            level = levels[c][k] = lower
    kept = {
        g for k in range(1, order + 1) for g in {*levels[0][k], *levels[1][k]}
        if max(levels[0][k].get(g, 0), levels[1][k].get(g, 0)) > discount
    }
    letters = {g: levels[0][1].get(g, 0) + levels[1][1].get(g, 0) for g in kept if len(g) == 1}
    whole = sum(letters.values()) + 0.5 * (len(letters) + 1)

    def probability(c, g):
        k = len(g)
        lower = probability(c, g[1:]) if k > 1 else (letters.get(g, 0) + 0.5) / whole
        heads = {x: n for x, n in levels[c][k].items() if x[:-1] == g[:-1]}
        total = sum(heads.values()) + prior
        if not any(x[:-1] == g[:-1] and len(x) == k for x in kept):
            return lower
        above = {x: max(n - discount, 0) for x, n in heads.items() if x in kept}
        return above.get(g, 0) / total + (1 - sum(above.values()) / total) * lower

    def told(word):
        marked = "\x02" + word + "\x03"
        grams = [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]
        return [sum(np.log(probability(c, g)) for g in grams) for c in (1, 0)]

    return levels, told


def test_toxicity_equals_plain_kneser_ney(spark):
    rng = random.Random(8)
    rows = [(" ".join(rng.choice(["abba", "ab", "babel", "Cabal", "ça", "ba"]) + rng.choice(["", "x", "el"]) for _ in range(6)), i % 3 == 0)
            for i in range(60)]
    rows = [(t, int(y)) for t, y in rows] + [("", 1), (None, 0), rows[0], ("zz zz zz", 1), ("\U0001d400\U0001d401 zz", 1)]
    frame = spark.createDataFrame([(t, int(y)) for t, y in rows], "text string, toxic int").dropDuplicates()
    grams = toxicity.count_grams(toxicity.count_words(frame))
    levels, told = plain_models([(t, int(y)) for t, y in rows], toxicity.ORDER, toxicity.DISCOUNT, toxicity.PRIOR)
    got = {r.g: (r.toxic, r.ordinary) for r in grams.collect()}
    expected = {g for c in levels for level in levels[c].values() for g in level}
    assert got == {g: tuple(levels[c][len(g)].get(g, 0) for c in (1, 0)) for g in expected}
    model = toxicity.fit(toxicity.summed(grams))
    seen = ["abba", "ab", "babelx", "cabalel", "ça", "zz", "unseen", "q", "abxabba", "x" * 50, "\U0001d400"]
    for word, difference in zip(seen, model.differences(seen)):
        toxic, ordinary = told(word)
        assert abs(toxic - ordinary - difference) < 1e-4, word


def test_toxicity_counts_tasks_of_one_class(spark):
    for toxic in (0, 1):
        frame = spark.createDataFrame([("a b", toxic), ("b", toxic), (None, toxic)], "text string, toxic int").coalesce(1)
        got = {r.w: (r.toxic, r.ordinary) for r in toxicity.count_words(frame).collect()}
        assert got == {"a": (toxic, 1 - toxic), "b": (2 * toxic, 2 - 2 * toxic)}
    assert toxicity.count_words(frame.filter("text IS NULL")).collect() == []


def test_toxicity_keeps_few_ngrams_of_any_corpus(spark):
    grams = spark.range(5000).selectExpr("lpad(id, 6, 'x') AS g", "1 + id % 7 AS toxic", "0L AS ordinary")
    for rare in (1e-6, 2e-4, 3e-4):
        counts = toxicity.summed(grams, rare=rare)
        total = sum(1 + i % 7 for i in range(5000))
        assert len(counts.grams) == sum(1 + i % 7 > max(1, rare * total) for i in range(5000)) <= 1 / rare


def test_toxicity_keeps_what_is_counted_twice_in_any_corpus(spark):
    """The same rare n-grams are told apart beside ten as beside ten million counts of others."""
    told = []
    for others in (10, 10_000_000):
        rows = [("\x02ab", 2, 0), ("ab\x03", 0, 3), ("once", 1, 1), ("abcdef", others, others), ("\x02a", 2, 3), ("a", 1, 1), ("b", 2, 2), ("\x03", 1, 2)]
        counts = toxicity.summed(spark.createDataFrame(rows, "g string, toxic long, ordinary long"))
        assert set(counts.grams.g) == {"\x02ab", "ab\x03", "abcdef", "\x02a", "b", "\x03"}
        told.append(toxicity.fit(counts).differences(["ab", "b"]).tolist())
    assert told[0] == told[1]


def test_toxicity_is_fitted_outside_the_driver(spark):
    """Of n-grams the driver holds keys and differences, not spellings and counts."""
    n = 30_000
    grams = spark.range(n).selectExpr("lpad(id, 6, 'x') AS g", "2 + id % 7 AS toxic", "0L AS ordinary")
    counts = toxicity.summed(grams)
    tracemalloc.start()
    model = toxicity.fit(counts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.orders[-1].grams) == n and most < 100 * n


def test_toxicity_counts_all_labelled_rows(spark, monkeypatch):
    docs = spark.range(2800).selectExpr("id AS doc_id", "concat('w', id, ' end') AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 28 = 0) AS toxic")
    counted = labels.filter("pmod(xxhash64('calibrate', doc_id), 7) != 0 AND toxic = 0").collect()
    expected = sum(py_fold(r.doc_id, 5) != 0 for r in counted)
    assert expected > 1800
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda counts: seen.append(counts) or fit(counts))
    toxicity.train(docs, labels)
    (row,) = seen[0].grams.query("g == '\x02end\x03'").itertuples()
    assert row.ordinary == expected


def test_toxicity_defined_cases(spark, monkeypatch):
    schema = "doc_id long, text string, score string, lang string, _toxicity int"
    rng = random.Random(6)
    rows = [(i, say(rng, "en", 30) + (" moron scum" if i % 3 == 0 else ""), "mine", "x", 1) for i in range(300)]
    docs = spark.createDataFrame([*rows, *rows[:20], (None, "moron scum", None, None, None), (7000, "ab " * 300_000, "", "", 0)], schema)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 5) for i in range(300)] + [(None, 1, 2), (4, None, 1), (3, 0, 0)], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == docs.columns and dict(got.dtypes)["score"] == "double"
    found = got.collect()
    assert len(found) == 322
    by_id = {}
    for r in found:
        assert by_id.setdefault(r.doc_id, r.score) == r.score
    assert by_id[None] > 0.5 and by_id[7000] < 0.5
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    joined = toxicity.train(docs, labels)
    assert [joined.score(t) for _, t, *_ in rows[:30]] == [model.score(t) for _, t, *_ in rows[:30]]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
