from __future__ import annotations

import math
import random
import zlib

from codexframe.llm import toxicity


def made(spark, n=600, seed=2):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(6)]
        label = int(rng.random() < 0.3)
        if label:
            at = rng.randrange(6)
            lines[at] += f" {rng.choice(('vile', 'nasty', 'foul'))}{rng.choice(('', 'ly', 'ness'))}"
        rows.append((i, ". ".join(lines), label))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), rows


def test_learns_from_documents_and_finds_the_sentence(spark):
    df, rows = made(spark)
    model = toxicity.fit(df.where("doc_id < 400"))
    scored = {r.id: r for r in toxicity.score(df, model).collect()}
    held = [r for r in rows if r[0] >= 400]
    right = sum((scored[i].score >= 0.5) == bool(y) for i, _, y in held)
    assert right / len(held) > 0.95
    for i, text, y in held:
        if y and scored[i].score >= 0.5:
            found = [o.sentence for o in scored[i].offending]
            truth = [n for n, s in enumerate(text.split(". ")) if any(w in s for w in ("vile", "nasty", "foul"))]
            assert not found or set(truth) & set(found)


def test_score_is_the_noisy_or():
    import numpy as np

    bias, weights = -2.0, {"bad$": 3.0, "bad": 0.0}
    text = "a bad one. fine\nvery bad bad"
    p = [1 / (1 + math.exp(-(bias + (3.0 if "bad" in s else 0.0)))) for s in toxicity.sentences(text)]
    want = 1 - np.prod([1 - x for x in p])
    assert len(p) == 3 and 0 < want < 1
    assert toxicity.sentences(None) == [] and toxicity.sentences("...") == []
    assert [len(s) for s in toxicity.sentences("w " * 130)] == [64, 64, 2]


def test_noisy_or_in_the_operator(spark):
    model = (-2.0, {"bad$": 3.0})
    got = toxicity.score(spark.createDataFrame([(1, "a bad one. fine\nvery bad bad")], "doc_id long, text string"), model).first()
    p = [1 / (1 + math.exp(-z)) for z in (1.0, -2.0, 1.0)]
    assert abs(got.score - (1 - (1 - p[0]) * (1 - p[1]) * (1 - p[2]))) < 1e-12
    assert [o.sentence for o in got.offending] == [0, 2] and got.n_sentences == 3


def _plain_fit(rows, least, steps):
    """Features, noisy-or gradient and Adam steps written out document by document."""
    bags = [[sorted(set(s)) for s in toxicity.sentences(t)] for _, t, _ in rows]
    labels = [y for *_, y in rows]
    n, n_toxic = len(rows), sum(labels)
    seen = {}
    for bag, y in zip(bags, labels):
        for f in {f for s in bag for w in s for f in toxicity.features(w)}:
            seen.setdefault(f, [0, 0])[y] += 1
    names = []
    for f, (clean, bad) in sorted(seen.items()):
        table = [(bad, n_toxic), (clean, n - n_toxic)]
        g = 2 * sum(x * math.log(x * n / ((bad + clean) * c)) for x, c in table if x)
        g += 2 * sum((c - x) * math.log((c - x) * n / ((n - bad - clean) * c)) for x, c in table if c > x)
        if g >= least and bad * (n - n_toxic) > clean * n_toxic:
            names.append(f)
    theta = {None: -4.0} | {f: 0.0 for f in names}  # None: the bias
    m, v = dict.fromkeys(theta, 0.0), dict.fromkeys(theta, 0.0)
    for step in range(1, steps + 1):
        grad = {f: (0.0 if f is None else 1e-4 * theta[f]) for f in theta}
        for bag, y in zip(bags, labels):
            known = [[f for w in s for f in toxicity.features(w) if f in theta] for s in bag]
            p = [1 / (1 + math.exp(-(theta[None] + sum(theta[f] for f in k)))) for k in known]
            rest = math.prod(1 - x for x in p)
            for k, x in zip(known, p):
                g = (x if y == 0 else -x * rest / (1 - rest)) / n  # of the loss, by the sentence's sum
                for f in [None, *k]:
                    grad[f] += g
        for f in theta:
            m[f], v[f] = 0.9 * m[f] + 0.1 * grad[f], 0.999 * v[f] + 0.001 * grad[f] ** 2
            theta[f] -= 0.1 * (m[f] / (1 - 0.9**step)) / (math.sqrt(v[f] / (1 - 0.999**step)) + 1e-8)
    return theta.pop(None), {f: w for f, w in theta.items() if abs(w) > 1e-3}


def test_fit_equals_plain_steps(spark):
    df, rows = made(spark, 160, seed=9)
    bias, weights = toxicity.fit(df, least=6.0, steps=40)
    want_bias, want = _plain_fit(rows, 6.0, 40)
    assert abs(bias - want_bias) < 1e-6 and set(weights) == set(want) and len(want) > 3
    assert all(abs(weights[f] - want[f]) < 1e-6 for f in want)


def test_held_out_documents(spark):
    from codexframe.llm.queries import op7_instance_toxicity

    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op7_instance_toxicity(spark, d).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(p and y for p, y in held)
    assert hit / sum(y for _, y in held) > 0.75 and hit / sum(p for p, _ in held) > 0.9


def test_odd_rows(odd, none):
    from pyspark.sql import functions as F

    labelled = odd.withColumn("toxic", F.when(F.col("doc_id") == 1, 1).when(F.col("doc_id") == 6, 0).otherwise(F.lit(None)))
    model = toxicity.fit(labelled)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if r.id in (3, 4, 5))
    assert toxicity.fit(none.withColumn("toxic", F.lit(1)))[1] == {}
    assert toxicity.fit(odd.withColumn("toxic", F.lit(1)))[1] == {}
    assert toxicity.score(none, model).count() == 0
