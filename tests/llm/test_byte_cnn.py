import numpy as np
import pyarrow as pa

from remarkt.llm import byte_cnn
from remarkt.llm.byte_cnn import identify, language_report, pooled, train, windows_of
from remarkt.llm.byte_cnn import sample as sample_of
from remarkt.llm.words import Texts


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_tables_equal_plain_convolution():
    network = train(["the quick brown fox " * 20, "der schnelle braune Fuchs über " * 20], ["en", "de"], epochs=1)
    classes, _, _ = windows_of(Texts(pa.array(["Größe of äpfel " * 30, "x"])))
    emb = network.embed[classes]
    plain = [np.max(sum(emb[:, j : byte_cnn.WINDOW - len(w) + 1 + j] @ w[j] for j in range(len(w))), 1) for w in network.weights]
    assert np.allclose(pooled(classes, network.tables()), np.maximum(np.concatenate(plain, 1) + network.bias, 0), atol=1e-4)


def test_windows_cover_whole_texts():
    classes, owner, used = windows_of(Texts(pa.array(["a" * 600, None, "", "b" * 256, "c"])))
    assert owner.tolist() == [0, 0, 0, 3, 4] and used.tolist() == [256, 256, 88, 256, 1]
    assert (classes[2, 88:] == 0).all() and (classes[2, :88] == byte_cnn.CLASS_OF[ord("a")]).all()


def test_odd_rows(documents):
    words = {"en": "the house and that with", "de": "der Häuser und nicht ßen"}
    docs = documents([(i, (words["en" if i % 2 else "de"] + " ") * 12) for i in range(60)] + [(70, None), (71, ""), (72, "123 !!"), (None, "the house and that with the"), (73, "x" * 300000)], ["en" if i % 2 else "de" for i in range(60)] + [None, "en", "en", None, None])
    got = {r.doc_id: r for r in language_report(docs.withColumnRenamed("source", "score")).collect()}
    assert len(got) == 65
    assert [got[i].lang_pred for i in (70, 71, 72)] == ["und"] * 3 and got[None].held_out is False
    assert got[None].lang_pred == "en" and all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert identify(docs.limit(0), docs).count() == 0
    assert {r.lang_pred for r in identify(docs, docs.limit(0)).collect()} == {"und"}


def test_learns_from_whole_texts_of_a_bounded_sample(documents):
    # what tells the languages apart stands at the end of long texts
    filler = "0123456789 " * 300
    texts = [filler + ("the house and that with " * 40 if i % 2 else "der Häuser und nicht ßen " * 40) for i in range(40)] + [f"the house {i}" for i in range(200)]
    docs = documents([(i if i < 40 else 1000, t) for i, t in enumerate(texts)], ["en" if i % 2 or i >= 40 else "de" for i in range(240)])
    rows = sample_of(docs, 4096)
    assert len(rows) == 41 and max(len(t) for t, _ in rows) > 4000
    got = {r.doc_id: r.lang_pred for r in identify(docs.where("doc_id < 40"), docs).collect()}
    assert all(got[i] == ("en" if i % 2 else "de") for i in got)


def test_languages_of_short_texts(documents):
    """Texts of three bytes teach too."""
    words = {"xx": "hut", "yy": "bob", "zz": "キ"}
    docs = documents([(i, words[k]) for i, k in enumerate(list(words) * 40)], list(words) * 40)
    got = {(r.text, r.lang_pred) for r in identify(docs, docs, keep=("text",)).collect()}
    assert got == {(t, k) for k, t in words.items()}


def test_all_languages_are_known(documents):
    """Six hundred languages, some of one text among frequent ones."""
    labels = [f"l{i % 600:03d}" if i < 700 else "l000" for i in range(4000)]
    docs = documents([(i, f"text number {i} " * 3) for i in range(4000)], labels)
    network = byte_cnn.network_of(docs, epochs=1)
    assert network.languages == sorted(set(labels))
    assert byte_cnn.picked(docs).count() < 2 * byte_cnn.SAMPLE


def test_windows_of_the_sample_are_bounded(documents):
    docs = documents([(i, "".join(chr(97 + (i * k * k + k // 7) % 26) for k in range(20000))) for i in range(8)] + [(9, "one")], ["en"] * 8 + ["de"])
    seen = []
    real = byte_cnn.fit
    byte_cnn.fit = lambda x, *a: seen.append((len(x), sorted(set(a[0])))) or real(x, *a)
    try:
        byte_cnn.network_of(docs, epochs=1, most=50)
    finally:
        byte_cnn.fit = real
    assert seen[0][0] < 100 and seen[0][1] == ["de", "en"]
