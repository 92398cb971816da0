"""Small documents with every odd case, and brute-force versions of the operators."""

import collections
import random

WORDS = "north wind rain stone river cloud lamp table green seven paper train glass salt honey".split()


def words_of(text):
    return (text or "").encode().split()


def lower_words(text):
    return (text or "").encode().lower().split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def odd_documents(spark, seed=3):
    """Null and empty texts, null and repeated ids, repeated rows, a long text, copies near and exact, shared passages,
    and columns named like the operators' own."""
    rng = random.Random(seed)
    base, passage = sentence(rng, 120), sentence(rng, 90)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one"), (9, "Two words"), (10, "two WORDS")]
    rows += [(None, base), (None, None), (11, sentence(rng, 40) + "\n" + passage + "\n" + sentence(rng, 40)), (12, passage + " " + sentence(rng, 10)), (12, sentence(rng, 60))]
    rows += [(13, sentence(rng, 4000) + " " + passage), (14, "é日本 " * 200), (15, "é日本 " * 200 + "x"), (16, "a" * 900), (17, "#$% &|<>*")]
    rows += [(20 + i, sentence(rng, rng.randrange(1, 150))) for i in range(20)]
    full = [(k, t, ["en", "fr", None][i % 3], [f"src{i % 4}", None, ""][i % 7 % 3], None if t is None else len(t), i, -i, "x", float(i)) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, k long, chunk long, bucket string, n double")


def ids_and_texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def jaccard_components(rows, n, num):
    """By position: shingle count and smallest linked id."""
    sets = []
    for _, t in rows:
        w = lower_words(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    return [(rows[i][0], len(sets[i]), min(least[root(i)]) if least[root(i)] and sets[i] else rows[i][0]) for i in range(len(rows))]


def repeated_windows(sequences, n):
    """For each sequence the marks of items covered by an n-window that starts anywhere twice."""
    seen = collections.Counter(bytes(s[i : i + n]) if isinstance(s, bytes) else tuple(s[i : i + n]) for s in sequences for i in range(len(s) - n + 1))
    out = []
    for s in sequences:
        marks = [False] * len(s)
        for i in range(len(s) - n + 1):
            if seen[bytes(s[i : i + n]) if isinstance(s, bytes) else tuple(s[i : i + n])] > 1:
                marks[i : i + n] = [True] * n
        out.append(marks)
    return out


def key(row):
    return repr(row)
