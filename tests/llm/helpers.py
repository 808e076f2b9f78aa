"""Small inputs that every operator is to bear, and brute-force forms of what SQL cannot express."""

import collections
import math
import re
import zlib

import regex

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = regex.compile(r"[\p{L}\p{N}\p{M}]+")

#: Null in any column, empty and odd texts, ties and repeated rows.
ODD = [
    (1, "the cat sat on the mat and saw the dog", "en", "a", 38),
    (2, "the cat sat on the mat and saw the dog", "en", "a", 38),
    (2, "the cat sat on the mat and saw the dog", "en", "a", 38),
    (3, "", "en", "b", 0),
    (4, None, "fr", "b", None),
    (5, "le chat est sur la table", "fr", None, 24),
    (6, "   \n\t ", None, "b", 6),
    (7, "1234 !!! ???", "en", "c", 12),
    (None, "no id at all here", "en", "c", 17),
    (8, None, None, None, None),
    (9, "x", "en", "c", 1),
    (10, "Größe ﬁnd ½ 日本語 🙂 İstanbul ΣΑΣ", "de", "c", 30),
]


def frame(spark, rows=ODD, schema=DOCS):
    """rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    for name in ("score", "key", "size", "h1", "rank", "root", "value", "bucket", "target", "digest", "place", "left", "n", "next", "own", "canon"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def held(doc_id, modulus, remainder):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def unigram_scores(rows):
    """For each (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = [(i, WORD.findall(lower(t)) + ["</s>"]) for i, t in rows]
    count = collections.Counter(w for i, ws in tokens if not held(i, 7, 2) for w in ws)
    n, v = sum(count.values()), len(count)
    base = lambda ws: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
    return sorted(((-1 if i is None else i, held(i, 7, 2), len(ws), sum(w in count for w in ws), n, round(base(ws), 6)) for i, ws in tokens))


def ngram_scores(rows, discount=0.75):
    """doc_id -> log10 probability by interpolated trigrams of all n-grams seen twice, for each (doc_id, text)."""
    texts = {i: ["<s>", *WORD.findall(lower(t)), "</s>"] for i, t in rows}
    count = collections.Counter()
    for i, ws in texts.items():
        if not held(i, 7, 2):
            count.update(tuple(ws[a : a + k]) for k in (1, 2, 3) for a in range(len(ws) - k + 1))
    kept = {g: c for g, c in count.items() if len(g) == 1 or c >= 2}
    children = collections.defaultdict(list)
    for g, c in kept.items():
        children[g[:-1]].append(c)
    n = sum(c for g, c in count.items() if len(g) == 1 and g != ("<s>",))
    v = sum(len(g) == 1 and g != ("<s>",) for g in count)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 1) / (n + v + 1)
        context = gram[:-1]
        if context not in kept:
            return p(gram[1:])
        back = 1 - sum(c - discount for c in children[context]) / count[context]
        return (max(kept[gram] - discount, 0) / count[context] if gram in kept else 0) + back * p(gram[1:])

    return {i: sum(math.log10(p(tuple(ws[max(0, a - 2) : a + 1]))) for a in range(1, len(ws))) for i, ws in texts.items()}


def near_classes(rows, similarity=0.8):
    """doc_id -> least doc_id of its class, by all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = ALNUM.findall((t or "").lower())
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([(*w, "#")])
    by_gram, shared = collections.defaultdict(list), collections.Counter()
    for i, c in sets.items():
        for g in c:
            by_gram[g].append(i)
    for g, ids in by_gram.items():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                shared[(a, b)] += min(sets[a][g], sets[b][g])
    size, root = {i: sum(c.values()) for i, c in sets.items()}, {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), m in shared.items():
        if m / (size[a] + size[b] - m) >= similarity:
            one, two = find(a), find(b)
            root[max(one, two)] = min(one, two)
    return {i: find(i) for i in sets}


def leaked(docs, items):
    """(doc_id, item_id) of items that lie in a document, on one alignment, with 80 % of their tokens equal."""
    words = lambda t: ALNUM.findall((t or "").lower())
    found = set()
    for d, t in docs:
        w = words(t)
        places = collections.defaultdict(list)
        for p, x in enumerate(w):
            places[x].append(p)
        for i, s in items:
            v = words(s)
            hits = collections.Counter(p - q for q, x in enumerate(v) for p in places[x])
            if len(v) >= 5 and hits and max(hits.values()) >= 0.8 * len(v):
                found.add((d, i))
    return found


def language_counts(rows, near=0.25):
    """Learnt from rows (doc_id, text, lang): a function of a text that gives its trigrams in each language's set, and their number."""
    def trigrams(text):
        points = [" ", *(c if c.isalpha() else " " for c in text.lower()), " "]
        return [tuple(points[i : i + 3]) for i in range(len(points) - 2) if points[i + 1] != " "]

    counts = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        if text is not None and lang is not None:
            counts[lang].update(trigrams(text))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    most = collections.Counter()
    for lang, c in counts.items():
        for g, n in c.items():
            most[g] = max(most[g], n / total[lang])
    sets = {lang: {g for g, n in c.items() if n / total[lang] >= near * most[g]} for lang, c in counts.items()}

    def of(text):
        grams = trigrams(text or "")
        return {lang: sum(g in s for g in grams) for lang, s in sets.items()}, len(grams)

    return of
