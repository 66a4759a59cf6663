import random
import re
import time

import pytest

from quarrywork.operators import detect, usage


def test_scores_equal_a_fold_over_all_events(spark):
    rng = random.Random(11)
    rows, n = [], 0
    for path, size, kinds in (("a", 1, ["search"]), ("b", 3, ["edit"]), ("c", 400, ["selected"]), ("d", 300, ["access"] * 9 + ["edit"]), ("e", 60, list(usage.FIRST)), (None, 45, ["selected", "search"]),
                              *[(f"r{i}", rng.randint(1, 50), list(usage.FIRST)) for i in range(40)]):
        for _ in range(size):
            rows.append((path, rng.choice(kinds), rng.randint(0, 20), n))
            n += 1
        rows.append((path, "other", 0, n := n + 1))
    events = spark.createDataFrame(rows, "path string, kind string, s int, id long").selectExpr("path", "kind", "timestamp_seconds(s) AS ts", "id")
    got = {r.path: (r.importance, r.recency, r.frequency) for r in usage.importance_scores(events, "path", "kind", "ts", "id").collect()}
    want = {}
    for path, kind, *_ in sorted((r for r in rows if r[1] in usage.FIRST), key=lambda r: r[2:]):
        if path not in want:
            want[path] = usage.FIRST[kind]
            continue
        i, recent, f = want[path]
        if kind in usage.IMPORTANCE_STEPS:
            more, bound = usage.IMPORTANCE_STEPS[kind]
            i = i + more if i < bound else 0.95
        if kind in usage.FREQUENCY_STEPS:
            more, bound = usage.FREQUENCY_STEPS[kind]
            f = f + more if f < bound else 0.95
        want[path] = i, 1.0 if kind != "search" else recent, f
    assert got == want


RULES = "rule string, regex string, words array<string>, type string, severity string, confidence double, positive boolean, language string"


def test_many_rules_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    rules = [(f"r{i}", rf"(?i)\b({a}|{b})\b \w", [a, b.upper()], "t", "low", 0.5, i % 2 == 0, rng.choice([None, "de"])) for i in range(200) for a, b in [rng.sample(vocabulary, 2)]]
    text = lambda: "\n".join(" ".join(rng.choice([str.upper, str.lower])(w) for w in rng.choices(vocabulary, k=rng.randint(0, 6))) for _ in range(rng.randint(1, 9)))
    docs = [(i, text(), rng.choice(["de", "en", None])) for i in range(80)] + [(90, None, "de"), (91, "", "de")]
    found = detect.detect_by_words(
        spark.createDataFrame(docs, "id int, text string, lang string"), "id", "text", spark.createDataFrame(rules, RULES), "lang", around=1
    )
    got = sorted((r.id, r.rule, r.line, r.context, r.positive) for r in found.collect())
    want = [
        (i, r[0], n + 1, "\n".join(lines[max(0, n - 1) : n + 2]), r[6])
        for i, t, lang in docs for lines in [(t or "").split("\n")] for n, line in enumerate(lines) for r in rules
        if re.search(r[1], line) and r[7] in (None, lang)
    ]
    assert got == sorted(want) and got


def test_a_rule_needs_words(spark):
    docs = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(Exception, match="needs words"):
        detect.detect_by_words(docs, "id", "text", spark.createDataFrame([("r", "a", [], "t", "low", 1.0, True, None)], RULES)).collect()


def test_cost_is_flat_in_rules(spark):
    """A hundred times the rules, of words that no text has, cost less than three times as much."""
    docs = spark.range(2000).selectExpr("id", "array_join(transform(sequence(1, 300), x -> concat('w', x % 50, if(x % 10 = 0, '\n', ' '))), '') AS text")

    def seconds(n):
        rules = spark.createDataFrame([(f"r{i}", f"q{i}", [f"q{i}" if i else "w1"], "t", "low", 1.0, True, None) for i in range(n)], RULES)
        begun = time.time()
        detect.detect_by_words(docs, "id", "text", rules).count()
        return time.time() - begun

    seconds(10)
    assert seconds(2000) < 3 * seconds(20) + 1
