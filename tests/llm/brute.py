"""Small inputs with the awkward cases, and plain versions of the operators."""

import hashlib
import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("kept", T.StringType()), ("bucket", T.IntegerType()))])


def docs(spark, texts, ids=None):
    """A table of documents, with extra columns whose names clash with inner ones."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1) for i, t in zip(ids, texts)], DOCS)


def sample(seed=1, n=60, vocabulary=30, passage=25):
    """Random texts with shared passages, copies, near copies, odd white space, and empty, null and long ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 5))) for _ in range(vocabulary)] + ["It's", "X1", "don't,", "-"]
    passages = [[r.choice(words) for _ in range(passage)] for _ in range(4)]
    out = []
    for _ in range(n):
        text = [r.choice(words) for _ in range(r.randint(1, 60))]
        if r.random() < 0.6:
            p = r.choice(passages)
            a = r.randint(0, 8)
            at = r.randint(0, len(text))
            text[at:at] = p[a : len(p) - r.randint(0, 5)]
        out.append("".join(w + r.choice([" ", " ", "\n", "  ", "\t", "  "]) for w in text))
    out += [out[3], out[3], out[5].upper(), out[7] + " tail", "", None, " \n ", "one", out[9] * 40, None, ""]
    r.shuffle(out)
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring(rows, width=13):
    owner = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            owner[k] = min(owner.get(k, i), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if owner[tuple(w[a : a + width])] < i:
                gone[a : a + width] = [True] * width
        yield i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))


def lines(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    lower = {c: c + 32 for c in range(65, 91)}
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(strip).translate(lower)
            first[k] = min(first.get(k, i), i)
    for i, t in rows:
        own = (t or "").split("\n")
        keys = [x.strip(strip).translate(lower) for x in own]
        kept = [x for x, k in zip(own, keys) if len(k) < least or first[k] == i]
        yield i, len(own), len(own) - len(kept), sha("\n".join(kept))


def leaks(rows, items, width=10):
    lower = {c: c + 32 for c in range(65, 91)}

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))

    for i, t in rows:
        w = split(t)
        hit, found = set(), set()
        for item, text in items:
            v = split(text)
            n = min(width, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(item))
        yield i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def byte_strings(rows, width=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - width + 1):
            k = b[a : a + width]
            first[k] = min(first.get(k, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - width + 1):
            if first[b[a : a + width]] < i:
                gone[a : a + width] = b"\1" * width
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        yield i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))


def near(rows, size=3, percent=85):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = words((t or "").translate(lower))
        sets.append({tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set())
    of = {i: i for i, _ in rows}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                of[y] = x
    return [(i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets)]
