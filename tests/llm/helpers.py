"""Small corpora with the awkward rows that every operator must bear, and plain versions of what operators do."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp string, _hash string"
DATA = "/root/testdata/sf0.001"


def documents(spark, texts, sources=None, ids=None):
    """Columns of documents and some whose names operators use themselves."""
    rows = []
    for i, t in enumerate(texts):
        source = None if sources is None else sources[i]
        rows.append((i if ids is None else ids[i], t, "en", source, None if t is None else len(t), -1, -1, "x", "y"))
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=40):
    """Prose, copies, near copies, shared passages, long lines, and null, empty and odd texts."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgéñz") for _ in range(draw.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage, line = prose(60), prose(30) + "."
    texts = [None, "", "   \n\t ", "one", "two words", "x" * 5000, "ab" * 700]
    for i in range(n):
        t = prose(draw.randint(5, 150))
        if i % 4 == 0:
            t += "\n" + passage + "\n" + prose(20)
        if i % 5 == 0:
            t = line + "\n" + t + "\n" + line
        if i % 7 == 0 and len(texts) > 10:
            t = texts[-1]
        if i % 11 == 3:
            t = texts[-2] + " extra"
        texts.append(t)
    texts.append(prose(4000))
    return texts


def real(spark, table="documents"):
    return spark.read.parquet(f"{DATA}/{table}.parquet")


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
