"""The pipeline on a small corpus, stage by stage against plain Python, and through run()."""

import random
import re

import corpus_pipeline as cp
import numpy as np

from quirelint.llm import bpe, resample

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 7))) for _ in range(300)]
    bad = ["trash", "scum", "moron", "pathetic"]
    items = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(5)]
    rows, labels = [], []
    for i in range(700):
        words = rng.choices(vocab, k=rng.randint(30, 120))
        if i % 6 == 0:
            words[3:3] = bad
        if i % 50 == 7:
            words[5:5] = items[i % 5][1].split()[:20]
        if i % 40 == 9:
            words.append("password=hunter2hunter2")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 6 == 0)))
    for i in range(700, 760):  # copies and near copies
        words = rows[(i % 20) * 7 + 1][1].split()
        if i % 2:
            words[4] = "edited"
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (None, "no id at all"), rows[1]]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], FIELDS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, items


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()


def test_pipeline(spark, tmp_path):
    path = str(tmp_path)
    rows, items = write(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    expected: list = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/out{k}")
        before, docs = [tuple(r) for r in docs.collect()], spark.read.parquet(f"{path}/out{k}")
        after = [tuple(r) for r in docs.collect()]
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 0:
            kept = {i for i, *_ in after}
            clean = {i for i, _ in rows if i is None or i >= 700 or i % 6}
            assert clean - {i for i in clean if i is not None and 700 <= i < 760} <= kept
            assert not {i for i in range(0, 700, 6)} & kept
            table = spark.read.parquet(f"{path}/documents.parquet")
            told = {r.doc_id: r.kept for r in resample.classify(table, spark.read.parquet(f"{path}/labels.parquet")).collect()}
            assert {r[0] for r in after} == {i for i, kept_ in told.items() if kept_}
        if k == 1:
            sets = [shingles(t) for _, t, *_ in before]
            label = list(range(len(before)))
            for x in range(len(before)):
                for y in range(x):
                    both = len(sets[x] & sets[y])
                    if both and None not in (before[x][0], before[y][0]) and 100 * both >= 75 * len(sets[x] | sets[y]):
                        label = [label[y] if v == label[x] else v for v in label]
            groups: dict = {}
            for r, v in zip(before, label, strict=True):
                groups.setdefault(v, []).append(r)
            expected = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
            assert sorted(map(str, after)) == sorted(map(str, expected))
        if k == 2:
            windows = {tuple(w[p : p + 10]) for _, t in items for w in [t.split()] for p in range(len(w) - 9)}
            hit = lambda t: any(tuple(w[p : p + 10]) in windows for w in [re.findall("[a-z0-9]+", (t or "").lower())] for p in range(len(w) - 9))
            assert sorted(map(str, after)) == sorted(str(r) for r in before if not hit(r[1])) and len(after) < len(before)
        if k == 3:
            want = [(i, t and re.sub(r"password=\w+", "[secret]", t), *rest) for i, t, *rest in before]
            assert sorted(map(str, after)) == sorted(str((i, t, a, b, n if t is None else len(t))) for i, t, a, b, n in want)
    whole = sorted(map(str, (tuple(r) for r in cp.run(spark, path).collect())))
    assert whole == sorted(map(str, after)) and len(whole) > 400
    enc = bpe.encoding(*bpe.public_vocabulary())
    assert {r[1] for r in after} == {len(np.array(enc.encode_ordinary(t or ""))) for _, t, *_ in want}
    assert all(len(r[4]) == 4 * r[1] for r in after)
