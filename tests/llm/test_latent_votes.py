import numpy as np
import pyarrow as pa

from remarkt.llm.latent_votes import WIDTH, Space, features, labelled, quality_report

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(good) > 40 and len(bad) > 5
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "BB!", "c|", "dd", "9", "the"], rng.integers(1, 40))) for _ in range(80)]
    counts = features(pa.array(texts))
    labels = rng.integers(0, 2, 60)
    space = Space.fit(counts[:60], labels, 8)
    points = Space.unit(Space.weigh(counts, space.idf) @ space.base)
    for i, score in enumerate(space.vote(counts, 5, 4.0, block=7)):
        cosine = space.vectors @ points[i]
        best = np.sort(cosine)[::-1][:5]
        near = [k for k in range(60) if cosine[k] >= best[-1] - 1e-6]
        if len(near) == 5:
            w = np.maximum(cosine[near], 1e-6) ** 4
            assert abs(score - (w * labels[near]).sum() / w.sum()) < 1e-4


def test_odd_rows(spark, documents):
    docs = documents([(i, "plain words here and there " * 5 if i % 2 else "XX!! YY!! ZZ!! " * 9) for i in range(60)] + [(90, None), (91, ""), (None, "plain words"), (92, "b" * 200000), (1, "plain words here")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (1, 1, 1), (91, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_report(docs.withColumnRenamed("source", "quality"), labels).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id != 1)
    assert quality_report(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_report(docs, labels.limit(0)).collect()} == {0.5}


def test_long_labelled_text_and_ids_that_repeat(spark, documents):
    rows = [(i, "plain words here and there " * 5 if i % 2 else "XX!! YY!! ZZ!! " * 9) for i in range(40)]
    rows += [(50, "word " * 100_000), *((51, f"plain words {i} here") for i in range(300))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(50, 0, 0), (51, 1, 0)], "doc_id bigint, quality int, toxic int")
    counts, _ = labelled(documents(rows), labels)
    assert len(counts) == 42 and np.isfinite(counts).all() and counts.max() == 100_000
    got = quality_report(documents(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 40)


def test_ties_go_to_the_first():
    space = Space(np.ones(WIDTH, np.float32), np.eye(WIDTH, 4, dtype=np.float32), np.array([[1, 0, 0, 0]] * 6, np.float32), np.array([1, 1, 0, 0, 0, 0], np.float32))
    counts = np.zeros((3, WIDTH), np.float32)
    counts[:, 0] = 1
    assert space.vote(counts, 2, 4.0).tolist() == [1, 1, 1] and np.allclose(space.vote(counts, 4, 4.0), 0.5)
