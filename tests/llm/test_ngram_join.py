import numpy as np
import pytest

from gristmill.llm import ngram_join
from gristmill.llm.components import components

from .helpers import DOCUMENTS, awkward, jaccard_components, prose


def edited(rng, text, n):
    words = text.split()
    for i in rng.integers(0, len(words), n):
        words[int(i)] = f"x{int(rng.integers(1 << 30))}"
    return " ".join(words)


def sample():
    rng = np.random.default_rng(11)
    passage = prose(rng, 70)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 700, 60)]
    for i in range(25):  # near copies, some near the threshold
        base = texts[int(rng.integers(60))]
        texts.append(edited(rng, base, int(rng.integers(1, 2 + len(base.split()) // 25))))
    base = prose(rng, 200)
    texts += [edited(rng, base, int(rng.integers(1, 5))) for _ in range(40)]  # a group of near copies
    texts += [passage + " " + prose(rng, int(rng.integers(20, 200))) for _ in range(60)]  # a quoted passage
    texts += [passage.upper()] * 3 + ["a b", "A B", "a", "", "one two three"]
    chain = prose(rng, 128).split()  # a chain: neighbours link, ends do not
    for i in range(8):
        chain[16 * i] = f"y{i}"
        texts.append(" ".join(chain))
    return texts


def test_against_all_pairs(spark):
    texts = sample()
    rng = np.random.default_rng(1)
    ids = [int(i) for i in rng.permutation(len(texts)) * 3 + 5]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCUMENTS)
    found = ngram_join.similar_documents(docs).collect()
    wanted, sizes = jaccard_components(dict(zip(ids, texts)))
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert {r.doc_id: r.n_shingles for r in found} == sizes
    kept = ngram_join.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values()))


@pytest.mark.parametrize("rounds, all_pairs", [(0, 8), (8, 0)])
def test_all_pairs_and_star_rounds_agree(spark, monkeypatch, rounds, all_pairs):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "ALL_PAIRS", all_pairs)
    texts = dict(enumerate(sample()[60:125]))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCUMENTS)
    found = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs).collect()}
    assert found == jaccard_components(texts)[0]


@pytest.mark.parametrize("size_class", range(1, 12))
def test_fragments_outnumber_the_differences(size_class):
    count, slack = ngram_join.fragments(size_class)
    largest = 2 ** (size_class + 1) - 1
    for a in (largest, largest - 1, (largest * 9 + 9) // 10):
        b = largest
        # The largest difference two sets of these sizes may have and still link.
        fits = [d for d in range(abs(a - b), a + b + 1) if (a + b - d) % 2 == 0 and 100 * (a + b - d) >= 90 * (a + b + d)]
        differ = max(fits, default=0)
        assert count - differ >= 1 + slack


def test_awkward(spark):
    docs = awkward(spark)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).where("doc_id is not null").collect())
    assert [f[:2] for f in found[:5]] == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]
    assert all(f[0] == f[2] for f in found[:6])
    assert [f[2] for f in found[6:]] == [7, 7, 7]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 7]
    assert ngram_join.similar_documents(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (8, 7), (7, 9), (1, 3), (20, 21), (6, 6), (5, 4)] + [(100 + i, 101 + i) for i in range(40)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_longer_shingles_and_a_lower_percentage_against_all_pairs(spark):
    texts = dict(enumerate(sample()))
    rng = np.random.default_rng(5)
    for n in (30, 90, 150, 330, 450, 700):  # three to eleven in a hundred words substituted
        base = prose(rng, n)
        texts |= {len(texts) + i: edited(rng, base, max(1, n * i // 300)) for i in range(8)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCUMENTS)
    found = ngram_join.similar_documents(docs, ngram_join.Rule(5, 80)).collect()
    wanted, sizes = jaccard_components(texts, 5, 80)
    assert wanted != jaccard_components(texts)[0]
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert {r.doc_id: r.n_shingles for r in found} == sizes


@pytest.mark.parametrize("percent", [50, 80, 89, 95])
def test_sets_that_may_link_share_a_class(percent):
    rule = ngram_join.Rule(5, percent)
    for a in range(1, 400):
        listed = ngram_join.size_classes(a, rule)
        for b in range(a, a * 100 // percent + 1):
            shared = ngram_join.size_classes(b, rule)[0]
            assert shared in listed
            count, slack = ngram_join.fragments(shared, rule)
            assert count - (a + b) * (100 - percent) // (100 + percent) >= 1 + slack


def test_one_row_of_each_component(spark):
    copies = [prose(np.random.default_rng(i), 40) for i in range(4)]
    rows = [
        (1, copies[0]), (1, copies[0]), (2, copies[1]), (2, copies[0]), (3, copies[1]), (None, copies[1]),
        (None, copies[2]), (None, copies[2]), (None, copies[2] + " more"), (None, copies[3]), (4, None), (4, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    kept = ngram_join.one_of_each(docs, ngram_join.Rule(5, 80), repeats=False)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id or 0, r.text or "")) for r in kept.collect())
    component = min((copies[2], copies[2] + " more"), key=lambda t: t not in [f[1] for f in found])
    assert found == sorted([(0, component), (0, copies[3]), (1, copies[0]), (2, copies[1]), (4, ""), (4, "")])


@pytest.mark.parametrize("percent", [50, 80, 89])
def test_linked_sets_share_enough_of_their_prefixes(percent):
    rule = ngram_join.Rule(5, percent)
    rng = np.random.default_rng(percent)
    for _ in range(3000):
        a, b = rng.integers(1, 120, 2)
        least = -(-percent * (int(a) + int(b)) // (100 + percent))
        if least > min(a, b):
            continue
        # Common n-grams at random places of both orders, the worst being the last ones.
        both = int(rng.integers(least, min(a, b) + 1))
        late = rng.random() < 0.5
        places = [np.arange(n - both, n) if late else np.sort(rng.choice(n, both, replace=False)) for n in (a, b)]
        (listed_a, needs_a), (listed_b, needs_b) = rule.prefix(int(a)), rule.prefix(int(b))
        shared = int(((places[0] < listed_a) & (places[1] < listed_b)).sum())
        assert shared >= max(needs_a, needs_b)
