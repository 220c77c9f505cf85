import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gristmill.llm import quality
from gristmill.llm.texts import stored

from .helpers import DOCUMENTS, awkward, prose, word_list


def counts(text):
    text = text or ""
    words = word_list(text)
    lines = [line for line in text.split("\n") if word_list(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def vector(c):
    n = max(c[0], 1)
    x = [1000 * math.log1p(c[0]), 1000 * math.log(max(c[1], 1) / n), 1000 * c[2] / n, min(1000 * c[3] / max(n // 10, 1), 1000), 1000 * c[4] / n]
    return [math.floor(v + 0.5) if v >= 0 else -math.floor(-v + 0.5) for v in x]


FLOORS = np.array(list(quality.FLOORS.values()), float)


def mcd(x, share=0.75):
    """The same estimate in numpy: (mean, inverse covariance, logarithm of the determinant)."""
    half = (len(x) + 1) // 2 - 1
    binned = np.floor(x / 20).astype(int)
    medians = np.sort(binned, axis=0)[half] * 20 + 10
    modes = [min(Counter(column).items(), key=lambda item: (-item[1], item[0]))[0] * 20 + 10 for column in binned.T]
    plain = np.diag(1 / (2 * FLOORS) ** 2)
    moments = np.linalg.inv(np.cov(x.T, bias=True) + np.diag(FLOORS**2))

    def classes(mean, inverse):
        d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
        return np.minimum(quality.CLASSES - 1, np.floor(24 * np.log2(1 + d))).astype(int)

    def concentrate(mean, inverse):
        least = np.inf
        while True:
            c = classes(mean, inverse)
            kept, reached = np.zeros(len(x), bool), 0
            for value in sorted(set(c)):
                if reached >= share * len(x):
                    break
                kept |= c == value
                reached = kept.sum()
            covariance = np.cov(x[kept].T, bias=True) + np.diag(FLOORS**2)
            logdet = np.linalg.slogdet(covariance)[1]
            if logdet >= least - quality.SETTLED:
                return least, mean, inverse
            least, mean, inverse = logdet, x[kept].mean(axis=0), np.linalg.inv(covariance)

    starts = [(medians, plain), (np.array(modes), plain), (x.mean(axis=0), moments)]
    logdet, mean, inverse = min((concentrate(*start) for start in starts), key=lambda found: found[0])
    middle = 2 ** ((np.sort(classes(mean, inverse))[half] + 1) / 24) - 1
    return mean, inverse * quality.CHI2_MEDIAN / max(middle, quality.CHI2_MEDIAN), logdet


def search(x, rng, share=0.75, starts=300):
    """An independent search: the smallest determinant from many small random subsets, with exactly
    ``share`` of the rows after each step. Returns (logdet, rows)."""
    h = math.ceil(share * len(x))
    best = (np.inf, None)
    for _ in range(starts):
        kept, before = rng.choice(len(x), 6, replace=False), np.inf
        while True:
            covariance = np.cov(x[kept].T, bias=True) + np.diag(FLOORS**2)
            logdet = np.linalg.slogdet(covariance)[1] if len(kept) == h else np.inf
            if logdet < best[0]:
                best = (logdet, kept)
            if logdet >= before - 1e-9 and len(kept) == h:
                break
            before = logdet
            centred = x - x[kept].mean(axis=0)
            kept = np.argsort(np.einsum("ij,jk,ik->i", centred, np.linalg.inv(covariance), centred), kind="stable")[:h]
    return best


def test_smallest_determinant_with_a_masked_cluster(spark):
    """A fifth of the documents lies together off the others: plain moments hide it."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(400):
        n = int(np.exp(rng.normal(6, 0.8)))
        n = max(n, 60)
        odd = i % 5 == 0
        per_word = rng.normal(9 if odd else 5, 0.3)
        share = 0.3 + 0.05 * rng.random() if odd else 0.02 * rng.random()
        rows.append(("en", f"s{i % 2}", n, int(n * per_word), int(n * share), 0, int(n * 0.05 * rng.random())))
    names = ["lang", "source", *quality.COUNTS]
    table = spark.createDataFrame(rows, names)
    found = {r.level: r for r in quality.estimates(table).collect()}
    assert len(found) == 4
    kept = [r.kept for r in quality.verdicts(table.coalesce(1), quality.estimates(table)).orderBy("n_words", "word_chars").collect()]
    by_order = sorted(range(400), key=lambda i: (rows[i][2], rows[i][3]))
    assert all(k == (i % 5 != 0) for k, i in zip(kept, by_order))
    for level, its in found.items():
        x = np.array([vector(r[2:]) for r in rows if not level.startswith("2") or level.endswith(f"={r[1]}")], float)
        assert its.docs == len(x)
        assert abs(its.logdet - mcd(x)[2]) < 1e-6
        logdet, closest = search(x, rng)
        # Whole classes hold a few documents more than the share.
        assert its.logdet < logdet + 0.2
        assert np.abs((np.array(its.mean) - x[closest].mean(axis=0)) / FLOORS).max() < 0.3


def sample(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        rows.append((i, prose(rng, int(rng.integers(60, 300))).replace(" w1", "\nw1"), "en", "s" if i < 140 else "rare", 0))
    for i in range(150, 165):
        rows.append((i, " ".join(w + "***" for w in prose(rng, 120).split()), "en", "s", 0))
    rows.append((165, "\n".join(["the same line again"] * 40), "en", "s", 0))
    return spark.createDataFrame(rows, DOCUMENTS), rows


def test_counts_and_verdicts(spark):
    docs, rows = sample(spark)
    found = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    expected = {r[0]: counts(r[1]) for r in rows}
    usable = {i: c for i, c in expected.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    x = np.array([vector(c) for i, c in usable.items() if rows[i][3] == "s"], float)
    everything = np.array([vector(c) for c in usable.values()], float)
    for i, c in expected.items():
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (i not in usable)
        # The rare source has too few documents and takes its language's estimate.
        mean, inverse, _ = mcd(x if rows[i][3] == "s" else everything)
        d = np.array(vector(c)) - mean
        assert abs(r.distance - d @ inverse @ d) < 1e-2 + 1e-6 * r.distance
        assert r.kept == (i in usable and d @ inverse @ d <= quality.CUTOFF)
    assert all(found[i].kept for i in range(150))
    assert not any(found[i].kept for i in range(150, 166))


def test_awkward(spark):
    docs = awkward(spark)
    found = quality.quality_report(docs).orderBy("doc_id").collect()
    assert [r.n_words for r in found] == [8, 0, 0, 0, 1, 2, 30000, 7, 7, 7]
    # Too few documents for any estimate: the base rules alone decide.
    assert [r.kept for r in found] == [r.n_words == 30000 and not r.base_failed for r in found]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert quality.quality_report(docs.limit(0)).count() == 0


def test_stage_keeps_what_the_report_keeps(spark):
    docs, _ = sample(spark)
    wanted = quality.quality_report(docs).where("kept").select("doc_id")
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == sorted(r.doc_id for r in wanted.collect())


def test_text_is_never_shuffled(spark):
    docs, _ = sample(spark)
    plan = quality.document_counts(docs, keep=[F.col("doc_id")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_steps_read_stored_vectors(spark, monkeypatch):
    docs, _ = sample(spark)
    counts = quality.document_counts(docs, keep=[F.col("lang"), F.col("source")]).cache()
    plans = []

    def noted(df, purpose, **options):
        plans.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, purpose, **options)

    monkeypatch.setattr(quality, "stored", noted)
    assert quality.estimates(counts).count()
    assert [purpose for purpose, _ in plans].count("vectors") == 1 and len(plans) > 3
    # Statistics and levels are computed for that table alone.
    assert not [plan for purpose, plan in plans if purpose != "vectors" and "ROUND(" in plan.upper()]
