import random
import re

from quarrywork.llm import chat, quality, urlfilter

SPACE = " \t\n\x0b\x0c\r"


def statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    runs = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in runs.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n ", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 50, "é ü\x0bñ 🙂 # * | <>\n\n#\n", "a\r\na\r\na\n"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += ["\n".join(rng.choice(["l1", "l2 x", " "]) for _ in range(9)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality.judge(docs, []).collect():
        expected = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        n, _, _, _, repeated = expected
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n) and r.kept == (not r.base_failed)


def test_quality_learns_rules(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = [f"word{rng.randrange(5000)}" for _ in range(40)]
        bad = i % 3 == 0
        if bad and i % 2:
            words = [w + "***" for w in words]
        elif bad:
            words = [w.upper() for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules and all(r.precision >= quality.MIN_PRECISION for r in rules)
    got = {r.doc_id: r.kept for r in quality.judge(docs, rules).collect()}
    assert sum(got[i] == bool(y) for i, y in labels) >= 880
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) == []


def test_urls(spark):
    urls = ["http://a.net/x", "https://example.net/en/1", "http://EXAMPLE.com/de/#f", "http://b.org/fr/?q", "http://b.org/fr", None]
    urls += ["no scheme", "x://net", "http://sub.example.net/en/", "http://a.org?u=://net/", "http://bad.org/p/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [urlfilter.Rule(("host:bad", "host:org"), 0.9, 0.1), urlfilter.Rule(("host:never",), 0.9, 0.1)]
    got = {r.page_id: r for r in urlfilter.judge(pages, rules).collect()}
    verdicts = [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))]
    assert verdicts[:6] == [
        ("a.net", "/x", "net/", "block"),
        ("example.net", "/en/1", "example.net/en/", "allow"),
        ("example.com", "/de/", "example.com/de/", "block"),
        ("b.org", "/fr/", "org/fr/", "allow"),
        ("b.org", "/fr", None, "allow"),
        ("", "", None, "allow"),
    ]
    assert verdicts[6:] == [
        ("", "", None, "allow"),
        ("net", "", None, "allow"),
        ("sub.example.net", "/en/", "example.net/en/", "allow"),
        ("a.org", "", None, "allow"),
        ("bad.org", "/p/1", None, "block"),
    ]
    sets = pages.select("page_id", urlfilter.tokens_of(urlfilter.host_of(pages.url), urlfilter.path_of(pages.url)).alias("tokens"))
    a, b = (sorted(map(tuple, urlfilter.matches(sets, rules, inline=n).select("page_id", "matched").collect())) for n in (9, 0))
    assert a == b and sum(m for _, m in a) == 1


SCHEMA = "tokens array<string>, bad boolean, confirms boolean"


def brute_force_rules(rows, min_rows, min_confidence, min_lift, confirming):
    """Every set of at most three tokens, counted one by one."""
    from itertools import combinations

    mined, others = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    least = max(min_confidence, min(1.0, min_lift * sum(r[1] for r in mined) / len(mined)))
    sets = {c for r in mined for n in (1, 2, 3) for c in combinations(sorted(r[0]), n)}
    told = {}
    for c in sets:
        held = [r[1] for r in mined if set(c) <= set(r[0])]
        if len(held) >= min_rows and sum(held) / len(held) >= least:
            told[c] = sum(held) / len(held)
    found = []
    for c, confidence in told.items():
        if any(set(d) < set(c) and told[d] >= confidence for d in told):
            continue
        held = [r[1] for r in others if set(c) <= set(r[0])]
        if not confirming or (len(held) >= confirming and sum(held) / len(held) >= least):
            found.append((c, round(confidence, 6)))
    return sorted(found, key=lambda x: (len(x[0]), x[0]))


def test_url_rules_equal_enumerated_ones(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        tokens = sorted({f"host:{rng.choice('abcd')}", f"part:{rng.choice('uvw')}", f"path:{rng.choice('xyz')}", "path:#"})
        bad = rng.random() < (0.9 if tokens[0] == "host:a" else 0.8 if "part:v" in tokens and "path:y" in tokens else 0.1)
        rows.append((tokens, bad, i % 3 == 0))
    frame = spark.createDataFrame(rows, SCHEMA).cache()
    for confidence, least, lift, confirming in ((0.5, 10, 1.5, 10), (0.7, 5, 1.0, 0), (0.3, 25, 2.0, 5)):
        rules = urlfilter.mine(frame, 0.0, confidence, least, lift, confirming)
        assert [(r.tokens, r.confidence) for r in rules] == brute_force_rules(rows, least, confidence, lift, confirming)
    assert urlfilter.mine(frame, 0.0, 0.5, 10)[0].tokens == ("host:a",)


def test_url_rules_that_do_not_hold_on_other_urls(spark):
    rng = random.Random(4)
    rows = [([f"host:{i % 40}", "path:#"], rng.random() < 0.25, i % 3 == 0) for i in range(3000)]
    assert urlfilter.mine(spark.createDataFrame(rows, SCHEMA)) == []
    assert urlfilter.mine(spark.createDataFrame([], SCHEMA)) == []


def test_url_tokens_are_one_for_one_fact(spark):
    urls = spark.createDataFrame([("http://m.spam-farm.net/en/12/x.html",)], "url string")
    row = urls.select(urlfilter.tokens_of(urlfilter.host_of(urls.url), urlfilter.path_of(urls.url)).alias("t")).first()
    assert row.t == ["host:m", "host:spam-farm", "host:net", "part:spam", "part:farm", "path:en", "path:#", "path:x", "path:html"]


def test_urls_defined_cases(spark):
    schema = "page_id long, url string, _set int, _hit string, matched int, tokens string"
    long = "http://bad.org/" + "a/" * 200_000
    rows = [(1, long, 1, "x", 1, "t"), (2, "http://bad.com/", 1, "x", 1, "t"), (2, "http://bad.com/", 1, "x", 1, "t"), (None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, schema)
    rules = [urlfilter.Rule(("host:bad",), 0.9, 0.1)]
    got = urlfilter.judge(pages, rules).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "allow"), (1, "block"), (2, "block"), (2, "block")]
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    split = pages.select("*", urlfilter.tokens_of(urlfilter.host_of(pages.url), urlfilter.path_of(pages.url)).alias("own"))
    for inline in (9, 0):
        found = urlfilter.matches(split, rules, "own", "matched", inline)
        assert sorted(found.columns) == sorted(split.columns)
        assert sorted((r.page_id or 0, r.matched, r._set or 0) for r in found.collect()) == [(0, False, 0), (1, True, 1), (2, True, 1), (2, True, 1)]


def test_quality_list_takes_the_best_condition_first():
    """Sequential covering against a search through all conditions, with the gain written out."""
    import math

    rng = random.Random(6)
    cells = []
    for _ in range(80):
        cuts = tuple(rng.randrange(6) for _ in range(3))
        bad = 9 if cuts[1] >= 4 else 5 if cuts[0] < 1 else 0
        cells.append((cuts, rng.random() < 0.3, bad + (rng.random() < 0.1), 0 if bad else 6))
    rules = quality.learn(cells)
    assert rules
    left = cells
    for conditions, n, precision in rules:
        inside = [c for c in left if not c[1]]
        before = math.log2(sum(c[2] for c in inside) / sum(c[2] + c[3] for c in inside))
        gains = {}
        for f in range(3):
            for k in range(1, 6):
                for sign in (">=", "<"):
                    some = [c for c in inside if (c[0][f] >= k) == (sign == ">=")]
                    bad, good = sum(c[2] for c in some), sum(c[3] for c in some)
                    if bad >= quality.MIN_ROWS and len(some) < len(inside):
                        gains[(f, sign, k)] = bad * (math.log2(bad / (bad + good)) - before)
        assert gains[conditions[0]] >= max(gains.values()) - 1e-6
        covered = [c for c in left if all((c[0][f] >= k) == (sign == ">=") for f, sign, k in conditions)]
        assert n == sum(c[2] + c[3] for c in covered) and abs(precision - sum(c[2] for c in covered) / n) < 1e-9
        left = [c for c in left if c not in covered]


def test_quality_defined_cases(spark):
    long = " ".join(f"word{i % 5000}" for i in range(100_000))
    docs = spark.createDataFrame([(1, long, "k", 1), (2, "same text", "k", 1), (2, "same text", "k", 1), (3, "", None, None)], "doc_id long, text string, kept string, bad int")
    got = quality.judge(docs, []).collect()
    assert sorted((r.doc_id, r.n_words, r.kept) for r in got) == [(1, 100_000, False), (2, 2, False), (2, 2, False), (3, 0, False)]
    assert [r.n_repeat_words for r in got if r.doc_id == 1] == [100_000]
    assert quality.judge(docs.limit(0), []).count() == 0
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, bad int")
    assert quality.train(docs.limit(0), labels) == [] == quality.train(docs, labels)


def test_chats_of_many_turns_and_of_equal_numbers(spark):
    rows = [(1, i, "user", f"turn {i}") for i in range(20_000)] + [(2, i, "user", f"turn {i}") for i in range(19_999)]
    rows += [(3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "assistant", "a"), (4, 0, "assistant", "a"), (4, 0, "user", "a"), (4, 0, "user", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    assert sorted(got) == [1, 3]
    assert got[1].n_turns == 20_000 and got[1].rendered.endswith("turn 19999<|im_end|>\n")
    assert got[3].rendered.startswith("<|im_start|>assistant\na<|im_end|>\n") and got[3].n_turns == 3


def test_chats(spark):
    says = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(texts)]
    rows = says(1, "a", "b") + says(2, "a", "b", "c") + says(3, "a", "b", "c") + says(4, "b") + says(5, "a", None)
    rows += [(None, 0, "user", "lost", "x"), (6, None, " User ", "", "x"), (6, None, " User ", "", "x"), (6, 1, None, "c", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h1 string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.format_chats(frame).collect()}
    assert sorted(got) == [2, 4, 5, 6]
    assert got[2] == (3, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n")
    assert got[6][0] == 2 and got[6][1].startswith("<|im_start|>user\n<|im_end|>\n<|im_start|>unknown\nc")
    assert chat.format_chats(frame.filter("conv_id < 0")).count() == 0


def test_url_rules_of_long_and_repeated_urls(spark):
    """Urls of thirty words: the same one a thousand times, and random ones, whose sets of three equal enumerated ones."""
    import time

    words = [f"path:w{i:02d}" for i in range(30)]
    same = [(["host:long", *words], i % 10 > 0, i % 3 == 0) for i in range(1000)]
    other = [([f"host:h{i % 7}", f"path:v{i % 11}"], i % 17 == 0, i % 3 == 0) for i in range(1500)]
    frame = spark.createDataFrame(same + other, SCHEMA).repartition(4).cache()
    assert frame.count() == 2500
    urlfilter.mine(frame)
    began = time.time()
    rules = urlfilter.mine(frame)
    assert time.time() - began < 10
    assert {r.tokens for r in rules} == {(t,) for t in ["host:long", *words]}

    rng = random.Random(5)
    rows = []
    for i in range(400):
        tokens = sorted({"host:a", *rng.sample(words[:22], 14)})
        rows.append((tokens, rng.random() < (0.9 if {"path:w01", "path:w02"} <= set(tokens) else 0.2), i % 3 == 0))
    found = urlfilter.mine(spark.createDataFrame(rows, SCHEMA), 0.0, 0.6, 30, 1.5, 5)
    want = brute_force_rules(rows, 30, 0.6, 1.5, 5)
    assert [(r.tokens, r.confidence) for r in found] == want and any(len(t) > 1 for t, _ in want)
