import corpus_pipeline
from corpus_pipeline import STAGES, run
from remarkt.llm.byte_cnn import identify
from remarkt.sources import store

import test_chosen_path
import test_nnls_packing
import test_sanitise
import test_suffix_leaks

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names, functions = zip(*STAGES, strict=True)
    assert names == ("language", "near_dedup", "decontaminate", "personal_data", "pack")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    out = []
    for f in functions:
        made = f(spark, docs, SF)
        if f is not functions[-1]:
            assert made.columns == docs.columns
            made = spark.createDataFrame(made.toPandas())
            out.append(sorted((r.doc_id, r.text) for r in made.collect()))
            docs = made
    # clean documents are known to be in a language
    assert len(out[0]) >= len(rows) - 2 and set(out[0]) <= set(rows)
    assert out[1] == [(d, t) for d, t in out[0] if d in {x[0] for x in test_chosen_path.brute(out[0], 5, 80) if x[3]}]
    hit = {x[0] for x in test_suffix_leaks.brute(out[1], items) if x[5]}
    assert hit and out[2] == [x for x in out[1] if x[0] not in hit]
    assert [d for d, _ in out[3]] == [d for d, _ in out[2]]
    for (_, before), (_, after) in zip(out[2], out[3], strict=True):
        assert (before == after) or sum(test_sanitise.brute(before)[:4])
        assert not test_sanitise.brute(after)[0]
    assert test_nnls_packing.check(out[3], made.collect()) > 0.9


def test_run_keeps_whole_result(spark):
    assert run(spark, SF).count() > 100
    assert corpus_pipeline.ORACLE_SQL is None


def test_null_and_repeated_rows(documents):
    docs = documents([(1, "the house is on the hill"), (1, "the house is on the hill"), (2, None), (None, "the house is on the hill"), (3, "")])
    kept = corpus_pipeline.near_dedup(None, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == [("1", "the house is on the hill"), ("2", ""), ("3", ""), ("None", "the house is on the hill")]


def test_texts_of_one_id_are_decided_each(documents):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    # 5 has two texts that stay and one whose like has a smaller id; two near copies of one id are one group
    rows = [(5, a), (5, a), (5, b), (5, c), (3, b + " more"), (7, a + " more"), (9, "d " + c), (None, a), (None, a), (None, b), (8, None), (8, None), (8, "")]
    rows += [(20, " ".join(f"e{i}" for i in range(40))), (20, " ".join(f"e{i}" for i in range(41)))]
    kept = corpus_pipeline.near_dedup(None, documents(rows).repartition(3), SF).collect()
    got = sorted(((r.doc_id, r.text) for r in kept if r.doc_id != 20), key=str)
    assert got == sorted([(3, b + " more"), (5, a), (5, c), (8, None), (8, ""), (None, a), (None, b)], key=str)
    assert sum(r.doc_id == 20 for r in kept) == 1


def test_language_keeps_what_is_likely_enough(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {(r.doc_id, r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE) for r in identify(docs, docs).collect()}
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} == {i for i, k in known if k}
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(documents([(None, None), (-1, ""), (-2, "123 !!"), (-3, None)]))
    assert all(r.doc_id is not None and r.doc_id >= 0 for r in corpus_pipeline.language(spark, odd, SF).collect())


def test_near_copies_by_five_words(documents):
    words = [f"w{i}" for i in range(140)]
    rows = [(1, " ".join(words[:100])), (2, " ".join(words[:122])), (3, " ".join(words[:70] + words[100:]))]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(None, documents(rows), SF).collect()) == [1, 3]


def test_empty_and_very_long(spark, documents):
    docs = documents([(1, "the house is on the hill and we saw it " * 30000), (2, None), (2, None)])
    for name, stage in STAGES[1:]:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert {r.doc_id for r in stage(spark, docs, SF).collect()} == {1, 2}, name
    assert corpus_pipeline.language(spark, docs.limit(0), SF).count() == 0


def test_only_the_result_stays_in_the_shared_folder(spark, tmp_path, monkeypatch):
    for module in (corpus_pipeline, store):
        monkeypatch.setattr(module, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in STAGES if s[0] in ("decontaminate", "personal_data", "pack")])
    assert run(spark, SF).count() > 0
    assert [p.name for p in tmp_path.glob("remarkt-pipeline-*/*/*")] == ["pack"] and not list(tmp_path.glob("remarkt-[!p]*/*"))
