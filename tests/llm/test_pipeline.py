"""The pipeline against a plain version of its stages, and the entry without the subpackage."""

import hashlib
import os
import shutil
import subprocess
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as X  # noqa: E402
import test_text_operators as T  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows():
    extra = [(700 + i, X.sentence(__import__("random").Random(i), 80) + f" password=abcdefgh{i}", "en", "hot" if i % 3 else "a", 1) for i in range(12)]
    return X.rows() + extra


def plain(rows):
    """The ids and texts that leave the mixing stage, each as often as it is taken."""
    kept = []
    for r in rows:
        n, _, _, _, again = T.counts_of(r[1])
        if n >= 50 and 100 * again <= 50 * n:
            kept.append(r)
    fps = [T.fingerprint(r[1]) for r in kept]
    distinct = sorted(set(fps))
    label = dict(zip(distinct, T.groups(distinct), strict=True))
    first = {}
    for r, f in zip(kept, fps, strict=True):
        k = (r[0] is None, r[0] or 0)
        if label[f] not in first or k < first[label[f]][0]:
            first[label[f]] = (k, r)
    docs = []
    for _, r in first.values():
        text, at, out = r[1], 0, ""
        for a, _, b in T.plain_secrets(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        docs.append((r[0], out + text[at:] if at else text, r[3]))
    size = {k: len(X.WORD.findall(t)) for k, (_, t, _) in enumerate(docs)}
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k, d in enumerate(docs) if d[2] == s) for s in sources}
    weight, free, budget = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, set(sources), 1.5 * sum(total.values())
    while True:
        level = (budget - sum(2 * total[s] for s in sources if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            break
        free -= over
    target = {s: level * weight[s] if s in free else 2.0 * total[s] for s in sources}
    draw = lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()
    passes = []
    for s in sources:
        for turn in (0, 1):
            words = turn * total[s]
            for k in sorted((k for k, d in enumerate(docs) if d[2] == s), key=lambda k: draw(docs[k][0])):
                words += size[k]
                if words - size[k] / 2 <= target[s]:
                    passes.append((words / target[s], draw(docs[k][0]), k))
    taken, used = [], 0
    for _, _, k in sorted(passes):
        used += size[k]
        if used > budget:
            break
        taken.append(docs[k])
    return taken


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    df = spark.createDataFrame(rows(), X.SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = X.folder(df, tmp_path, labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    token = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, _ in plain(rows()):
        ids = token.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), T.sha(np.array(ids, "<u4").tobytes()), T.sha(t)))
    assert len(want) > 60 and len({w[0] for w in want}) < len(want)
    assert T.got(docs, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == T.key(want)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    folder = X.folder(X.empty(spark), tmp_path, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline_sends_no_exploded_fingerprints_to_all(spark, tmp_path):
    """Near-dedup of 6,000 different texts: 396,000 half variants (32 MB) come from a file of 0.1 MB."""
    import corpus_pipeline

    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{w}" for w in ws) for ws in rng.integers(0, 10**6, (6000, 8))]
    made = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(9000 + i, t, "en", "a", len(t)) for i, t in enumerate(texts[:50])]
    folder = X.folder(spark.createDataFrame(made, X.SCHEMA), tmp_path)
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(8 << 20))
    try:
        left = corpus_pipeline.one_of_each(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).select("doc_id").collect()
    finally:
        spark.conf.set(limit, before)
    assert sorted(r.doc_id for r in left) == list(range(6000))


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "chronopanel"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "chronopanel" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
