"""Brute-force twins and awkward inputs."""

import re
from collections import defaultdict

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use for their own columns.
CLASHING = "id n node key keys row bucket size rank copy kept words line best tokens level component hashes a.b".split()


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, vocabulary, n))


def awkward(spark, rows=None):
    """Null, empty, blank, long and repeated texts, null keys, and clashing columns."""
    long = " ".join(f"word{i % 7919}" for i in range(30_000))
    table = rows or [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", None, 4),
        (4, "one", None, "a", 3),
        (5, "one two", "en", "b", 7),
        (6, long, "en", "b", len(long)),
        (7, "same words in both of these rows", "en", "a", 32),
        (7, "same words in both of these rows", "en", "a", 32),
        (8, "same words in both of these rows", "en", "a", 32),
        (None, "a row without an id has words too", "en", "a", 33),
    ]
    docs = spark.createDataFrame(table, DOCUMENTS)
    for name in CLASHING:
        docs = docs.selectExpr("*", f"'clash' as `{name}`")
    return docs


def jaccard_components(texts, n=3, percent=90):
    """component by id, over a dict of texts, by comparing all pairs of distinct sets."""
    sets = {}
    for key, text in texts.items():
        w = word_list(ascii_lower(text))
        sets[key] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {key: key for key in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    by_set = defaultdict(list)
    for key, found in sets.items():
        if found:
            by_set[found].append(key)
    distinct = list(by_set)
    pairs = [(by_set[s][0], other) for s in distinct for other in by_set[s][1:]]
    for i, s in enumerate(distinct):
        for t in distinct[:i]:
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    pairs.append((by_set[s][0], by_set[t][0]))
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {key: find(key) for key in texts}, {key: len(s) for key, s in sets.items()}


def leaked(text, items, window=13, allowed=2):
    """Whether a text holds a window of an item with at most ``allowed`` differences."""
    words = re.findall(r"[^\W_]+", ascii_lower(text))
    for item in items:
        its = re.findall(r"[^\W_]+", ascii_lower(item))
        for at in range(-allowed, len(words) - window + 1 + allowed):
            for start in range(len(its) - window + 1):
                place = at
                equal = sum(
                    0 <= place + i < len(words) and words[place + i] == its[start + i] for i in range(window)
                )
                if equal >= window - allowed:
                    return True
    return False
