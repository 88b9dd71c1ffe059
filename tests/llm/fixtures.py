"""Small documents with nulls, empty and long texts, copies, near copies and clashing columns."""

import random
import re

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéz") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed=5, n=60):
    """``(doc_id, text)`` rows, doc_ids in no order."""
    rng = random.Random(seed)
    shared = prose(rng, 70)
    base = [prose(rng, rng.randint(8, 160)) for _ in range(n)]
    rows = list(enumerate(base))
    for i in range(25):  # near copies of one text, a few words changed
        w = base[3].split() + prose(random.Random(1), 60).split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w)))
    for i in range(12):  # a passage inside different texts
        rows.append((2000 + i, prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 15)))
    rows += [(3000, base[5]), (3001, base[5]), (3002, base[6].upper())]
    rows += [(4000, ""), (4001, None), (4002, "  \n\t "), (4003, "one two"), (4004, "ONE two"), (4005, "one"), (4006, "ab " * 30000), (4007, "x" * 5000), (4008, "é" * 300)]
    rows += [(0, base[0])]  # a repeated row
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    """Documents with columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
    for c in ("id", "key", "node", "rank", "bucket", "part", "code", "comp", "__b", "codes", "size"):
        df = df.withColumn(c, F.lit("clash"))
    return df
