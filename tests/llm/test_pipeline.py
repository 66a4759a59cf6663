import math

import pytest
from test_native import statistics

import corpus_pipeline
from quarrywork.llm import quality, toxicity
from quarrywork.llm.common import table
from quarrywork.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def passes(text, rules):
    """The quality rules in plain Python."""
    n, chars, symbols, dup_lines, repeated = statistics(text)
    if n < 20 or 100 * repeated > 30 * n:
        return False
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    told = {
        "n_words": n, "mean_word": chars / n, "symbol_share": symbols / n, "bang_share": text.count("!") / n,
        "capital_share": sum("A" <= c <= "Z" for c in text) / chars, "digit_share": sum("0" <= c <= "9" for c in text) / chars,
        "dup_line_share": dup_lines / len(lines), "repeat_share": repeated / n, "kinds_share": len(set(words_of(text))) / n,
    }
    bad = lambda rule: all((told[k] >= t) == (sign == ">=") for k, sign, t in rule.conditions)
    return not any(map(bad, rules))


def words_of(text):
    import re

    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def toxic_score(text, model):
    """The score from the words' differences, one word after the other."""
    found = toxicity.words(text)
    told = [min(max(float(model.differences([w])[0]) - toxicity.MARGIN, 0), toxicity.MOST) for w in found]
    z = model.slope * math.log((sum(told) / len(told) if told else 0) + toxicity.FLOOR) + model.offset
    return 1 / (1 + math.exp(-z))


def test_stages(spark):
    from test_neardup import brute_force

    docs = table(spark, SF, "documents").cache()
    labels = table(spark, SF, "labels")
    first = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    assert first.columns == docs.columns
    rules = quality.train(docs, labels)
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect() if passes(r.text, rules)}
    second = corpus_pipeline.drop_toxic(spark, first, SF).cache()
    model = toxicity.train(first, labels)
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in first.collect() if toxic_score(r.text, model) < 0.5}
    third = corpus_pipeline.drop_near_duplicates(spark, second, SF).cache()
    expected = brute_force([(r.doc_id, r.text) for r in second.collect()], 5, 80)
    assert {r.doc_id for r in third.collect()} == {i for i, (_, c) in expected.items() if i == c}
    packed = corpus_pipeline.pack(spark, third, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in third.collect()}


def test_run_equals_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "packing"]
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0


def write(spark, folder, docs, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int, _toxicity string, kept string, said long, id int"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_odd_rows(spark, tmp_path):
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    more = (None, None, 5, 1, "mine", "yes", 7, 3)
    rows = [(1, text(1), *more), (1, text(2), *more), (2, text(1), *more), (3, text(3), *more), (3, text(3), *more), (None, text(4), *more)]
    rows += [(4, None, *more), (5, "", *more), (None, None, *more), (6, text(6) + " tail", *more), (7, text(6), *more)]
    write(spark, tmp_path, rows, [(1, 1, 0), (None, None, None), (1, None, 0)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = after.cache()
    kept = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    assert kept == sorted([(0, text(4)), (1, text(1)), (1, text(2)), (3, text(3)), (6, text(6) + " tail")])
    assert all((r._row, r._toxicity, r.kept, r.said) == (1, "mine", "yes", 7) for r in docs.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id or 0 for r in packed}) == [0, 1, 3, 6]


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_folder_must_be_shared():
    from quarrywork.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
