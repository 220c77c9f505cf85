import itertools
import math
from collections import Counter

import numpy as np
import pytest

from gristmill.llm import decontaminate, licenses, token_rollup, url_rules
from gristmill.scratch import new_folder

from .helpers import DOCUMENTS, awkward, leaked


def item(n, start=0):
    return " ".join(f"item{start + i}" for i in range(n))


def test_spaced_seeds_miss_no_window(spark):
    """Every pair of substitutions in a window of exactly WINDOW matching places."""
    words = item(13).split()
    rows = []
    for a in range(13):
        for b in range(a, 13):
            changed = list(words)
            changed[a] = changed[b] = "other"
            rows.append((len(rows), "x y z " + " ".join(changed) + " u v", "en", "s", 0))
    three = list(words)
    three[2] = three[6] = three[10] = "other"
    rows.append((len(rows), " ".join(three), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCUMENTS)
    benchmark = spark.createDataFrame([(1, item(13)), (2, item(12, 50)), (3, None)], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert set(found) == set(range(len(rows) - 1))
    assert all((r.start_word, r.end_word, r.item_id) == (3, 16, 1) for r in found.values())
    assert all(leaked(rows[i][1], [item(13)]) == (i in found) for i in range(len(rows)))


def test_leaks_of_awkward_rows(spark):
    extra = [(20, item(40), "en", "s", 0), (20, "another text " + item(20, 5), "en", "s", 0), (None, item(15), "en", "s", 0),
             (21, item(11), "en", "s", 0), (22, item(20) + " filler " * 30 + item(20), "en", "s", 0)]
    docs = awkward(spark).unionByName(awkward(spark, extra))
    benchmark = spark.createDataFrame([(1, item(40)), (1, item(40)), (None, item(14)), (4, "")], "item_id long, text string")
    benchmark = benchmark.selectExpr("*", "'clash' as id", "'clash' as words", "'clash' as key")
    found = decontaminate.contaminated(docs, benchmark).collect()
    spans = sorted((r.doc_id or 0, r.item_id or 0, r.start_word, r.end_word, r.matched) for r in found)
    # A window may hang over an end of the document by the substitutions allowed.
    assert [s for s in spans if s[1] == 1] == [
        (0, 1, 0, 15, 15), (20, 1, 0, 22, 20), (20, 1, 0, 40, 40), (21, 1, 0, 11, 11), (22, 1, 0, 22, 20), (22, 1, 50, 70, 20),
    ]
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(1, 9))
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_licenses(spark):
    apache = licenses.TEMPLATES["Apache-2.0 notice"]
    texts = [
        (30, "some words\n  " + apache.upper() + "  \nmore words", "en", "s", 0),
        (31, licenses.TEMPLATES["MIT permission"].replace(", ", ",\n"), "en", "s", 0),
        (32, "Licensed under the Apache License, Version 1.1.", "en", "s", 0),
        (33, "All rights reserved.", "en", "s", 0),
        (33, "All rights reserved.", "en", "s", 0),
    ]
    docs = awkward(spark).unionByName(awkward(spark, texts))
    found = sorted((r.doc_id, r.line, r.license, r.dice) for r in licenses.scan_licenses(docs).collect())
    assert found == [
        (30, 2, "Apache-2.0 notice", 1.0),
        (31, 0, "MIT permission", 1.0),
        (33, 1, "Proprietary notice", 1.0),
        (33, 1, "Proprietary notice", 1.0),
    ]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    tied = {"b": "one two three", "a": "one two three"}
    docs = spark.createDataFrame([(1, "One, two: three", "en", "s", 0)], DOCUMENTS)
    assert [r.license for r in licenses.scan_licenses(docs, tied).collect()] == ["a"]


def test_size_bounds_lose_no_match():
    for threshold in (0.5, 0.8, 1.0):
        fit = licenses._by_size([7], threshold)
        for a in range(1, 60):
            possible = 2 * min(a, 7) / (a + 7) >= threshold - 1e-12
            assert possible == (a < len(fit) and fit[a] == [0])


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, source string, lang string, version string, tokens long, old_tokens long")


def totals(rollup):
    return sorted((r.source or "", r.lang or "", r.version, r.docs, r.tokens) for r in rollup.totals().collect())


def test_rollup_batches_count_once(spark):
    folder = new_folder(spark, "test-rollup")
    rollup = token_rollup.TokenRollup(spark, folder)
    assert totals(rollup) == []
    first = changes(spark, [("insert", "a", "en", "v1", 10, None)] * 3 + [("insert", None, None, "v1", None, None)])
    second = changes(spark, [("delete", "a", "en", "v1", 10, None), ("revise", "a", "en", "v1", 4, 10)])
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    assert totals(rollup) == [("", "", "v1", 1, 0), ("a", "en", "v1", 3, 30)]
    assert rollup.commit("two", second) and rollup.commit("none", first.limit(0))
    wanted = [("", "", "v1", 1, 0), ("a", "en", "v1", 2, 14)]
    assert totals(rollup) == wanted
    assert rollup.compact() == 3 and totals(rollup) == wanted
    assert not rollup.commit("two", second) and totals(rollup) == wanted
    assert rollup.commit("three", changes(spark, [("delete", "a", "en", "v1", 7, None)] * 2))
    rollup.compact()
    assert totals(token_rollup.TokenRollup(spark, folder)) == wanted[:1]
    with pytest.raises(ValueError):
        rollup.commit("../x", first)
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit("bad", changes(spark, [("upsert", "a", "en", "v1", 1, None)]))
    assert totals(rollup) == wanted[:1]


def test_a_batch_that_was_cut_short_is_written_anew(spark):
    folder = new_folder(spark, "test-rollup")
    rollup = token_rollup.TokenRollup(spark, folder)
    rows = changes(spark, [("insert", "a", "en", "v1", 10, None)])
    rollup.commit("one", rows)
    rollup._files.delete(f"{folder}/batches/one/_SUCCESS")
    assert totals(rollup) == []
    assert rollup.commit("one", rows)
    assert totals(rollup) == [("a", "en", "v1", 1, 10)]


def test_urls(spark):
    urls = [
        (1, "https://Www.Example.ORG/en/1?x=1", "example.org/en/1", "block"),
        (2, "https://www.example.org/en/2", "org/", "allow"),
        (3, "http://a.b.com/de/", "com/de/", "block"),
        (4, "http://notexample.org/es/", "org/", "allow"),
        (5, "https://example.org", None, "block"),
        (6, None, None, "allow"),
        (7, "no scheme/org/", None, "allow"),
        (7, "no scheme/org/", None, "allow"),
        (8, "http://net?de/x", None, "allow"),
        (9, "https://x.example.net/es/5", None, "block"),
    ] + [(100 + i, f"https://h{i}.example.org/es/{i}", "example.org/es/", "block") for i in range(20)]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u, _, _ in urls], "page_id long, url string, tokens string, host string")
    found = url_rules.judge_urls(pages, min_support=0.2).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in found if r.page_id) == sorted((i, rule, v) for i, _, rule, v in urls)
    parts = {r.page_id: (r.host, r.path) for r in found}
    assert parts[1] == ("www.example.org", "/en/1") and parts[5] == ("example.org", "") and parts[8] == ("net", "")
    assert parts[6] == parts[7] == ("", "")
    assert url_rules.judge_urls(pages.limit(0)).count() == 0
    alone = url_rules.judge_urls(pages.where("page_id = 9")).collect()
    assert [r.verdict for r in alone] == ["allow"]


def best_rules(labelled, open_sets, min_support, min_confidence=0.8, most=3):
    """The verdict of each open set by every set of up to ``most`` tokens."""
    told, n = Counter(), Counter()
    for tokens, verdict in labelled:
        for k in range(1, most + 1):
            for needs in itertools.combinations(sorted(tokens), k):
                told[needs, verdict] += 1
                n[needs] += 1
    least = math.ceil(min_support * len(labelled))
    rules = [(-c / n[s], -c, len(s), s, v) for (s, v), c in told.items() if c >= least and c / n[s] >= min_confidence]
    fits = {tokens: [r for r in rules if set(r[3]) <= set(tokens)] for tokens in open_sets}
    return {tokens: min(found)[4] for tokens, found in fits.items() if found}


def test_mined_rules_are_those_of_all_token_sets(spark):
    rng = np.random.default_rng(3)
    names = [f"p:{x}|{i}" for i, x in enumerate("abcdefghijklmnopq")]
    pool = [tuple(sorted(set(rng.choice(names, size=int(rng.integers(1, 12)))))) for _ in range(30)]
    labelled = [(pool[int(rng.integers(0, 20))], "block" if rng.random() < 0.5 else "allow") for _ in range(120)]
    labelled += [(("p:same", "p:too", "p:zoo"), "block")] * 30
    open_sets = [*pool, ("p:too",), ("p:a|0", "p:zoo"), ("p:unknown",)]
    frame = spark.createDataFrame(labelled, "tokens array<string>, verdict string")
    sets = spark.createDataFrame([(x,) for x in set(open_sets)], "tokens array<string>")
    expected = best_rules(labelled, open_sets, 0.03, 0.6)
    assert set(expected.values()) == {"block", "allow"}
    for wide in (3, 5, 12):
        rules, classes = url_rules.mine_rules(frame, min_support=0.03, min_confidence=0.6, wide=wide)
        found = url_rules.match_rules(sets, rules, classes).collect()
        assert {tuple(r.tokens): r.mined for r in found} == expected


def test_popular_long_urls(spark):
    path = [f"s{i}" for i in range(24)]
    urls = [f"https://a.example.org/es/{'/'.join(path)}"] * 100
    urls += [f"https://a.example.org/es/{'/'.join(path[:i] + path[i + 1:])}" for i in range(24) for _ in range(5)]
    urls += ["https://b.net/s3/s5", "https://b.net/other"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_rules.judge_urls(pages).collect()}
    assert len(found) == len(urls) and [found[i] for i in (0, 219, 220, 221)] == ["block", "block", "block", "block"]


def test_short_items_are_found(spark):
    items = [(n, item(n, 100 * n)) for n in range(1, 13)]
    rows = [(n, f"x y z {text} u v", "en", "s", 0) for n, text in items]
    for n, text in items:  # one word substituted
        for at in range(n):
            words = text.split()
            words[at] = "other"
            rows.append((100 * n + at, "x y z " + " ".join(words) + " u v", "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCUMENTS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert all((found[n].item_id, found[n].start_word, found[n].end_word, found[n].matched) == (n, 3, 3 + n, n) for n, _ in items)
    whole = {100 * n + at for n, _ in items if decontaminate.allowed(n) for at in range(n)}
    assert set(found) == whole | {n for n, _ in items}
    assert decontaminate.allowed(13) == 2


def test_only_rows_with_a_leak_go(spark):
    rows = [(None, item(15)), (None, "a clean text"), (1, item(15)), (1, "another clean text"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    benchmark = spark.createDataFrame([(1, item(15))], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, benchmark, by_row=True)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a clean text"), (1, "another clean text"), (2, "")]


def test_a_commit_during_a_compaction_counts_once(spark, monkeypatch):
    rollup = token_rollup.TokenRollup(spark, new_folder(spark, "test-rollup"))
    other = token_rollup.TokenRollup(spark, rollup._folder)
    rollup.commit("one", changes(spark, [("insert", "a", "en", "v1", 5, None)]))
    plain = token_rollup.TokenRollup._sum

    def late(self, paths):
        if self is rollup:
            other.commit("two", changes(spark, [("insert", "a", "en", "v1", 5, None)]))
        return plain(self, paths)

    monkeypatch.setattr(token_rollup.TokenRollup, "_sum", late)
    assert rollup.compact() == 1 and totals(other) == [("a", "en", "v1", 2, 10)]
    assert other.compact() == 2 and totals(other) == [("a", "en", "v1", 2, 10)]


def test_of_two_compactions_at_once_one_counts(spark, monkeypatch):
    rollup = token_rollup.TokenRollup(spark, new_folder(spark, "test-rollup"))
    other = token_rollup.TokenRollup(spark, rollup._folder)
    for name in ("one", "two"):
        rollup.commit(name, changes(spark, [("insert", "a", "en", "v1", 5, None)]))
    plain, begun = token_rollup.TokenRollup._sum, []

    def overtaken(self, paths):
        if self is rollup and not begun:
            begun.append(1)
            assert other.compact() == 2 and other.compact() == 2
        return plain(self, paths)

    monkeypatch.setattr(token_rollup.TokenRollup, "_sum", overtaken)
    try:
        assert rollup.compact() == 0
    except Exception as gone:  # the second of the other's compactions removed what this one reads
        assert "PATH_NOT_FOUND" in str(gone) or "FileNotFound" in str(gone) or "does not exist" in str(gone)
    monkeypatch.undo()
    assert totals(rollup) == [("a", "en", "v1", 2, 10)]
    assert not rollup.commit("one", changes(spark, [("insert", "a", "en", "v1", 5, None)]))
