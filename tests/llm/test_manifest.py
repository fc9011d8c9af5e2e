"""The Merkle manifest against a plain tree of lists, for blocks of one, two and six levels."""

import hashlib
import zlib

import fixtures as X
import numpy as np
import pytest

from chronopanel.llm import manifest as M


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha(field(doc_id), field(source), field(lang), field(n_chars), field(text))


def climb(level):
    """All levels of a tree."""
    out = [level]
    while len(level) > 1:
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
        out.append(level)
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        start = i - i % 3
        run = level[start : start + 3]
        out.append((run[: i - start], run[i - start + 1 :]))
        i //= 3
    return out


def plain(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        mine = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((mine, climb([leaf(r, r[1]) for r in mine])))
    over = climb([levels[-1][0] for _, levels in trees])
    out = []
    for k, (mine, levels) in enumerate(trees):
        for i, r in enumerate(mine):
            path = siblings(levels, i) + siblings(over, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            at = leaf(r, r[1].replace("\n", "") if hit else r[1])
            for a, b in path:
                at = sha(*a, at, *b)
            out.append((r[0], levels[0][i], levels[-1][0], over[-1][0], sha(*[h for a, b in path for h in a + b]), at, at == over[-1][0]))
    return out


def digest(df, m):
    return [(r.doc_id, r.leaf.hex(), r.subroot.hex(), m.root.hex(), r.proof, r.folded.hex(), r.verified) for r in df.collect()]


key = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_against_plain_trees(spark, height):
    docs = X.documents(spark, clash=True)
    m = M.manifest(docs, height)
    got = sorted(digest(M.proofs(m), m), key=key)
    want = sorted(plain(X.rows()), key=key)
    assert got == want
    assert {r[6] for r in want} == {True, False}


def test_many_sources_and_one(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 40:02d}", i) for i in range(90)]
    for some in (rows, [r[:3] + ("one",) + r[4:] for r in rows[:28]], rows[:1]):
        m = M.manifest(spark.createDataFrame(some, X.SCHEMA), 2)
        assert sorted(digest(M.proofs(m), m), key=key) == sorted(plain(some), key=key)


def test_places_fill_the_array_and_subtrees_are_runs():
    for levels in range(1, 9):
        seen = np.concatenate([M.place(levels, d, np.arange(3**d)) for d in range(levels)])
        assert sorted(seen.tolist()) == list(range(M.nodes_of(levels)))
    top = 7 // 2  # a subtree below the cut is one run of the array
    below = np.concatenate([M.place(7, d, np.arange(5 * 3 ** (d - top), 6 * 3 ** (d - top))) for d in range(top, 7)])
    assert below.max() - below.min() + 1 == len(below)


def test_empty(spark, tmp_path):
    assert M.proofs(M.manifest(X.empty(spark))).count() == 0
    assert M.query(spark, X.folder(X.empty(spark), tmp_path)).count() == 0
