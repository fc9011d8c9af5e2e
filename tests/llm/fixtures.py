"""Small tables with the cases that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashes."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that an input may have besides its own, with names that operators use inside.
CLASHES = "row, size, draw, fp, rid, key, base, added, spans, owner, hash, words, block, part, kind, verdict, label, slot, finish".split(", ")


def sentence(rng, n):
    parts = ["the", "of", "stone", "river", "Mühle", "agua", "token", "ring", "edge", "lamp", "grün", "petite", "x1", "9a", "moss"]
    return " ".join(rng.choice(parts) + rng.choice(["", "a", "en", "ing", "é"]) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    base = [sentence(rng, rng.choice([1, 2, 5, 60, 120])) for _ in range(n)]
    shared = sentence(rng, 40)
    out = [(i, t, "en", rng.choice(["a", "b", "hot", "hot", "hot", None]), len(t)) for i, t in enumerate(base)]
    out += [(100 + i, f"{sentence(rng, 9)} {shared} {sentence(rng, 7)}", "en", "hot", 0) for i in range(12)]
    out += [(200 + i, base[3] if i % 2 else base[4] + " tail", None, "b", None) for i in range(10)]  # copies
    near = sentence(rng, 150)
    out += [(300 + i, near.replace(" ", "\n", 1) + f" w{i}", "de", "a", 1) for i in range(10)]  # near-copies
    out += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, " \t\n ", "en", "a", 4), (403, "ab" * 3000, "en", "a", 6000)]
    out += [(404, "word " * 4000, "en", "a", 20000), (405, "é　ü 日本 \U0001f600" * 60, "fr", "b", 1), (406, "line one\nline one\nline two\n\n\nline one", "en", "b", 1)]
    out += [out[-1], out[-1], (None, base[5], "en", "a", 3), (None, None, None, None, None)]  # repeated rows, null keys
    return out


def documents(spark, seed=1, n=60, clash=False):
    df = spark.createDataFrame(rows(seed, n), SCHEMA).repartition(5)
    if clash:
        for name in CLASHES:
            df = df.withColumn(name, df["n_chars"])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folder(df, tmp_path, name="documents", **others):
    for table, frame in {name: df, **others}.items():
        frame.write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)
