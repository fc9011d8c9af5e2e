"""Spot signatures against a plain version on lists and sets."""

import hashlib
import re

import fixtures as X

from chronopanel.llm import spots as S

STOP = set(S.WORDS)


def plain_spots(text):
    words = re.sub(r"""[\x20\x09-\x0D.,;:!?()"]+""", " ", text.lower()).strip(" ").split(" ")
    if words == [""]:
        return set()
    out = {" " + " ".join(words[:3])}
    for i, w in enumerate(words):
        chain = []
        while len(chain) < 3 and i + len(chain) + 1 < len(words) and words[i + len(chain) + 1] not in STOP:
            chain.append(words[i + len(chain) + 1])
        if w in STOP and chain:
            out.add(" ".join([w, *chain]))
    return out


def fingerprint(spots):
    return f"{len(spots)}-" + hashlib.md5("\n".join(sorted(spots, key=str.encode)).encode()).hexdigest()


def likeness(a, b):
    if not a and not b:
        return 1.0
    if not a or not b or min(len(a), len(b)) < max(len(a), len(b)) * 0.05:
        return 0.0
    return len(a & b) / len(a | b)


def plain(rows):
    texts = sorted({(r[0], r[1] or "") for r in rows}, key=lambda d: (d[0] is None, -(d[0] or 0), hashlib.md5(d[1].encode()).hexdigest()))
    answer = {}
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        a, b, c = plain_spots(t), plain_spots(edited), plain_spots(nxt)
        answer[i, t] = (i, len(t), edited, fingerprint(a), fingerprint(b), round(likeness(a, b), 12), round(likeness(a, c), 12))
    return sorted((answer[r[0], r[1] or ""] for r in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in df.collect()), key=str)


def prose(seed=3):
    """Rows with common words between content words, so that chains of all lengths occur."""
    import random

    rng = random.Random(seed)
    words = ["stone", "river", "lamp", "x1", "The", "of", "und", "la", "Der", "É", "moss,", "edge."]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 30, 200]))), "en", "a", 1) for i in range(60)]
    return rows + X.rows() + [(500, rows[4][1], "en", "b", 1), (501, rows[4][1], "en", "b", 1), (7, "another text of seven", "en", "b", 1), (600, "the of and", "en", "a", 1), (601, '" , .', "en", "a", 1), (602, "a" * 200_000 + " the end", "en", "a", 1)]


def test_against_sets(spark):
    rows = prose()
    df = spark.createDataFrame(rows, X.SCHEMA).repartition(7)
    for name in X.CLASHES + ["body", "mark", "next", "third", "set", "spots", "edited", "part"]:
        df = df.withColumn(name, df["n_chars"])
    want = plain(rows)
    assert got(S.likeness_of_next(df)) == want
    alike = {r[0]: r[3] for r in want}
    assert alike[500] == alike[501] and [r for r in want if r[0] == 501][0][6] == 1.0


def test_one_row_and_none(spark, tmp_path):
    assert S.likeness_of_next(X.empty(spark)).count() == 0
    rows = [(5, "the moss of stone", "en", "a", 1)]
    assert got(S.likeness_of_next(spark.createDataFrame(rows, X.SCHEMA))) == plain(rows)
    assert S.query(spark, X.folder(X.empty(spark), tmp_path)).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_partitions_lose_nothing(spark):
    sizes = spark.range(1, 1500, 7).selectExpr("id AS n").crossJoin(spark.range(1, 1500, 13).selectExpr("id AS m"))
    far = sizes.filter("least(n, m) >= greatest(n, m) * 0.05").select((S.partition(sizes["n"]) - S.partition(sizes["m"])).alias("apart"))
    assert far.filter("abs(apart) > 1").count() == 0
