import random

import numpy as np

from tessera.llm import toxicity as tx
from tessera.llm.queries import op3_toxicity


def auc(pos, neg):
    neg = np.sort(neg)
    return float(np.mean((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")) / 2 / len(neg)))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    pos, neg = (np.array([r.score for r in rows if r.toxic == k]) for k in (1, 0))
    assert auc(pos, neg) > 0.96
    assert (pos >= 0.5).mean() > 0.88 and (neg >= 0.5).mean() < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def corpus(n=600):
    rnd, rows = random.Random(5), []
    words = [f"word{i}" for i in range(300)]
    for i in range(n):
        toxic = int(i % 3 == 0)
        text = [rnd.choice(words) for _ in range(20)]
        if toxic and i % 9:
            text.append("vileslur")
        if rnd.random() < (0.7 if toxic else 0.05):  # a biased sample: one group is named in toxic texts
            text.append("muslim")
        rows.append((i, " ".join(text), toxic))
    return rows


def test_counterfactual_term_lowers_the_score_of_a_group_name(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, label int")
    neutral = spark.createDataFrame([(1, "the muslim family cooks dinner"), (2, "the christian family cooks dinner"), (3, "vileslur word1")], "doc_id bigint, text string")
    out = {}
    for strength in (0.0, 5.0):
        model = tx.fit(df, df, fairness=strength)
        out[strength] = {r.doc_id: r.score for r in tx.score(neutral, model).collect()}
    assert out[0.0][1] > 0.5 and out[5.0][1] < 0.5
    assert abs(out[5.0][1] - out[5.0][2]) < 0.1 * abs(out[0.0][1] - out[0.0][2]) + 0.02
    assert out[5.0][3] > 0.5


def test_odd_inputs(spark):
    rows = corpus(60) + [(70, None, 1), (71, "", 0), (72, "word1 " * 30_000, None), (None, "x", 1), (5, "word1", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int").selectExpr("*", "1 as score", "'a' as cols")
    got = tx.score(df, tx.fit(df, df)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = df.where("label > 5")
    assert tx.score(none, tx.fit(none, none)).count() == 0
    one_kind = df.where("label = 1")
    assert all(r.score > 0.5 for r in tx.score(df, tx.fit(df, one_kind)).collect())


def plain_sums(rows, index, terms):
    """Mean outer product of the changes of all pairs and of all mentions, in dense arrays."""
    swaps = tx.swaps_of(terms)
    feats = tx.Features()

    def dense(sentence):
        v = np.zeros(1 << tx.BITS)
        slots, x = feats.of_text(sentence)
        v[slots] = x
        return v[index]

    found, added, single = [], [], []
    for _, text, _ in rows:
        for sentence in tx.sentences(text):
            words = tx._WORD.findall(sentence)
            other = tx.swapped(sentence, swaps)
            if other != sentence:
                found.append(dense(sentence) - dense(other))
            n = len(set(words))
            added += [(dense(a) - dense(b)) * tx.scale(1) / tx.scale(n + 1) for a, b in swaps.items()]
            single += [dense(a) * tx.scale(1) / tx.scale(n + 1) for a in swaps]
    mean = lambda d: np.mean([np.outer(v, v) for v in d], axis=0) if d else 0
    return mean(found) + mean(added), len(found), len(added), mean(single)


TERMS = (("muslim", "christian", "jewish"), ("wordman", "word7"), ("alone",))


def test_counterfactual_sums_and_fit_against_dense_arrays(spark):
    rows = [(i, t + (". The muslim word1 here" if i % 7 == 0 else ""), y) for i, t, y in corpus(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int").repartition(5)
    model = tx.fit(df, df, n_features=200, fairness=3.0, identity_terms=TERMS)
    want, pairs, mentions, single = plain_sums(rows, model.index, TERMS)
    assert (model.pairs, model.mentions) == (pairs, mentions) and pairs > 15 and model.touched == np.count_nonzero(np.abs(want).sum(1))
    sums, *_ = tx.counterfactuals(df, model.index, TERMS)
    got = np.zeros((len(model.index),) * 2)
    got[sums[0], sums[1]] = sums[2]
    assert np.abs(got - want).max() < 1e-6
    # the same loss, descended in dense arrays
    want = want + single
    feats, x, y = tx.Features(), np.zeros((len(rows), len(model.index))), np.array([r[2] for r in rows], float)
    for k, (_, text, _) in enumerate(rows):
        slots, v = feats.of_text(text)
        at = np.searchsorted(model.index, slots)
        for a, s, value in zip(at, slots, v):
            if a < len(model.index) and model.index[a] == s:
                x[k, a] = value
    names = sorted(tx.swaps_of(TERMS))
    more = [(text, label) for _, text, label in rows for k in [tx.mention_of(text, names)] if k >= 0]
    assert len(rows) * 0.5 < len(more) <= len(rows)
    also = np.zeros((len(more), len(model.index)))
    for k, (text, _) in enumerate(more):
        slots, v = feats.of_text(f"{text} {names[tx.mention_of(text, names)]}")
        at = np.searchsorted(model.index, slots)
        for a, s, value in zip(at, slots, v):
            if a < len(model.index) and model.index[a] == s:
                also[k, a] = value
    x, y = np.vstack([x, also]), np.append(y, [float(label) for _, label in more])
    cost = np.where(y == 1, 3.0, 1.0) / len(y)

    def loss(w, b):
        raw = x @ w + b
        return (cost * (np.logaddexp(0, raw) - y * raw)).sum() + 1e-5 * w @ w / 2 + 3.0 * w @ want @ w

    w, b, m, v = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, 401):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * cost
        grad = np.append(x.T @ g + 1e-5 * w + 6.0 * want @ w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    assert abs(loss(w, b) - loss(model.weight, model.bias)) < 1e-4 * loss(w, b)
    assert np.abs(x @ w + b - x @ model.weight - model.bias).max() < 0.05


def test_the_penalty_acts_on_the_standard_tables(spark):
    """No labelled text names a group there; mentions give their names weights, and the penalty changes them and the scores."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.where(~tx.held_out(labels.doc_id)).selectExpr("doc_id", "toxic as label")
    free, held = tx.fit(docs, learn, fairness=0.0), tx.fit(docs, learn)
    assert held.pairs == 0 and held.mentions > 10**6 and held.touched > 100
    raw = lambda m, t: m.raw(*tx.Features().of_text(t))
    gaps = [np.mean([abs(raw(m, f"the {a} family cooks dinner") - raw(m, f"the {b} family cooks dinner")) for a, b in tx.swaps_of(tx.IDENTITY_TERMS).items()]) for m in (free, held)]
    assert gaps[0] > 0.02 and gaps[1] < 0.5 * gaps[0]
    some = docs.where("doc_id < 2000")
    a, b = ({r.doc_id: r.score for r in tx.score(some, m).collect()} for m in (free, held))
    assert max(abs(a[i] - b[i]) for i in a) > 1e-6


def test_late_ids_take_part_in_the_penalty(spark):
    """Only the documents with the largest ids name the group; the penalty still holds its weight."""
    rows = [(i, t, y) for i, t, y in ((i, t.replace(" muslim", ""), y) for i, t, y in corpus(500))]
    rows += [(10**6 + i, t + (" muslim" if y else ""), y) for i, t, y in corpus(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    swap = tx.fit(df, df, fairness=5.0, identity_terms=(("muslim", "christian"),))
    free = tx.fit(df, df, fairness=0.0, identity_terms=(("muslim", "christian"),))
    change = lambda m: abs(m.raw(*tx.Features().of_text("muslim")) - m.raw(*tx.Features().of_text("christian")))
    assert swap.pairs > 30 and change(swap) < 0.2 * change(free)
    assert tx.fit(df, df, identity_terms=()).touched == 0


def test_terms_that_no_text_names_still_take_part(spark):
    """A prefix that a group's name shares with a toxic word carries less score under the penalty."""
    rows = [(i, t.replace("vileslur", "muslinx").replace(" muslim", ""), y) for i, t, y in corpus(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    near = [tx.fit(df, df, fairness=f) for f in (0.0, 20.0)]
    assert near[1].pairs == 0 and near[1].mentions > 0 and near[1].touched > 0
    plain, held = (m.raw(*tx.Features().of_text("the muslim family")) - m.bias for m in near)
    assert plain > 0.1 and abs(held) < 0.4 * plain


def test_the_driver_holds_neither_counts_of_all_slots_nor_boxed_features(spark):
    """One array of a number per slot would be 8 MB; features of the sample are packed."""
    import tracemalloc

    rows = [(i, " ".join(f"common{k}" for k in range(i % 50, i % 50 + 200)) + (" vileslur" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    tracemalloc.start()
    try:
        model = tx.fit(df, df)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.index) > 200 and most < 12e6


def test_products_go_block_by_block():
    rnd = np.random.default_rng(4)
    lengths = rnd.integers(0, 9, 300)
    cols, counts, over = rnd.integers(0, 40, lengths.sum()).astype("<u2"), rnd.integers(1, 5, lengths.sum()).astype("<u4"), rnd.random(300) + 1
    dense = np.zeros((300, 40))
    np.add.at(dense, (np.repeat(np.arange(300), lengths), cols), counts / np.repeat(over, lengths))
    w, g = rnd.random(40), rnd.random(300)
    for block in (1, 7, 1 << 16):
        x = tx.Rows(lengths, cols, counts, over, block)
        assert np.allclose(x.times(w), dense @ w) and np.allclose(x.back(g, 40), g @ dense)
    none = tx.Rows(np.zeros(3, np.int64), cols[:0], counts[:0], over[:3])
    assert none.times(w).tolist() == [0.0] * 3 and not none.back(g[:3], 40).any()
