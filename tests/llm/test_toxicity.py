import numpy as np
from conftest import SF01

from threadlens.llm import queries, toxicity


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    hashes = toxicity.Hashes()
    rows = []
    for i in range(n):
        words = [f"w{j}" for j in rng.integers(0, 3000, rng.integers(5, 300))]
        label = int(i % 5 == 0)
        if label:
            words.insert(int(rng.integers(0, len(words))), ("vile", "foul")[i % 2])
        rows.append((hashes.of(" ".join(words)), label, ("en", "de")[i % 2]))
    return rows


def test_learns_words_and_leaves_clean_texts_alone():
    model = toxicity.train(made(600), {0: 1.0, 1: 1.0})
    held = made(300, seed=1)
    score = np.array([model.score(h) for h, _, _ in held])
    label = np.array([y for _, y, _ in held])
    assert ((score >= 0.5) == label).mean() > 0.97
    assert model.score(toxicity.Hashes().of("")) < 0.5
    assert set(model.thresholds) <= {"en", "de"}


def test_convolution_by_hand():
    net = toxicity.Network()
    hashes = toxicity.Hashes().of("a b c d e")
    rows = np.concatenate([toxicity.buckets(hashes), np.zeros((2, toxicity.HASHES), np.int64)])
    vectors = np.concatenate([net.state["table"][k][rows[:, k]] for k in range(toxicity.HASHES)], axis=1)
    want = []
    for w in toxicity.WIDTHS:
        all_values = [vectors[i:i + w].ravel() @ net.state[f"filter{w}"] for i in range(5)]
        want.append(np.max(all_values, axis=0) + net.state[f"bias{w}"])
    assert np.allclose(net.pooled(hashes)[0], np.concatenate(want), atol=1e-5)


def test_chunks_do_not_change_the_pooled_values(monkeypatch):
    net, hashes = toxicity.Network(), toxicity.Hashes().of(" ".join(f"w{i}" for i in range(500)))
    whole = net.pooled(hashes)[0]
    monkeypatch.setattr(toxicity, "_CHUNK", 7)
    assert np.allclose(net.pooled(hashes)[0], whole)


def test_hard_rows(spark, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (9, 0), (8, 0), (None, 1), (3, None)],
                                   "doc_id long, toxic int")
    model = toxicity.fit(clashing, labels)
    got = toxicity.score(clashing, model, keep=("doc_id",)).collect()
    assert len(got) == clashing.count() and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(empty, labels.limit(0))
    assert none.network is None and toxicity.score(clashing, none, keep=("doc_id",)).agg({"score": "max"}).first()[0] == 0


def test_rows_that_repeat_an_id_keep_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, shares: seen.append((len(rows), shares)))
    docs = spark.range(4000).selectExpr("if(id < 3000, 7, id) as doc_id", "concat('text ', id) as text", "'en' as lang")
    docs = docs.union(docs.filter("doc_id = 3500").crossJoin(spark.range(2000)).select("doc_id", "text", "lang"))
    labels = spark.createDataFrame([(7, 0), (3500, 1), (3501, 1)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, per_class=100)
    rows, shares = seen[0]
    assert 2 < rows < 160 and shares[1] == 1.0 and 0.02 < shares[0] < 0.05
    copies = spark.createDataFrame([(7, "same", "en")] * 500, "doc_id long, text string, lang string")
    toxicity.fit(copies, labels, per_class=100)
    assert seen[1][0] == 1


def test_held_out_scores(spark):
    rows = queries.op2_toxicity(spark, SF01).join(
        spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    learnt = [r for r in rows if not r.held_out]
    assert np.mean([r.predicted == r.toxic for r in learnt]) > 0.95
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.85


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda rows, shares: (rows, shares))
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    few = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(4000)], "doc_id long, toxic int")
    rows, shares = toxicity.fit(docs, few)
    assert len(rows) == 4000 and set(shares.values()) == {1.0}
    learnt = []
    monkeypatch.setattr(toxicity, "train_shards", lambda rows: learnt.append(rows.count()))
    toxicity.fit(docs, spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(6000)], "doc_id long, toxic int"))
    assert learnt == [6000]


def test_shards_learn_words(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "VISITS", 3000)
    def texts(n, seed):
        rng = np.random.default_rng(seed)
        return [(i, " ".join(f"w{j}" for j in rng.integers(0, 500, 40)) + (f" vile w{i % 9}" if i % 5 == 0 else ""), ("en", "de")[i % 2])
                for i in range(n)]
    rows = spark.createDataFrame(texts(900, 0), "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "LOCAL_ROWS", 0)
    monkeypatch.setattr(toxicity, "SHARD", 300)
    model = toxicity.fit(rows, labels)
    again = toxicity.fit(rows, labels)
    assert all(np.array_equal(v, again.network.state[k]) for k, v in model.network.state.items())
    assert model.thresholds == again.thresholds and set(model.thresholds) == {"en", "de"}
    hashes = toxicity.Hashes()
    assert np.mean([(model.score(hashes.of(t)) >= 0.5) == (i % 5 == 0) for i, t, _ in texts(400, 1)]) > 0.95
