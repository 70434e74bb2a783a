import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rosterspark.llm import language_id, toxicity


def auc(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    return np.mean([(a > b) + (a == b) / 2 for a in scores[labels == 1] for b in scores[labels == 0]])


def test_toxicity_learns_marked_words(spark):
    rng = np.random.default_rng(0)
    common = ["".join(rng.choice(list("etaoinsrh"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words, toxic = list(rng.choice(common, 60)), int(i % 3 == 0)
        if toxic:
            words[5], words[30] = rng.choice(["grumblefitz", "nastywort", "vilepudding"], 2)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    held = [i for i in found if found[i].held_out]
    assert 60 < len(held) < 180 and np.mean([found[i].predicted == labels[i][2] for i in held]) > 0.97
    assert auc([found[i].score for i in held], [labels[i][2] for i in held]) > 0.98
    assert {r.doc_id for r in toxicity.keep_ordinary(docs, known).collect()} == {i for i in found if not found[i].predicted}


def test_toxicity_held_out_accuracy(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    rows = toxicity.toxicity(read("documents"), read("labels")).join(read("labels"), "doc_id").where("held_out").collect()
    assert auc([r.score for r in rows], [r.toxic for r in rows]) > 0.9
    clean = [r.predicted for r in rows if not r.toxic]
    assert np.mean(clean) < 0.05 and np.mean([r.predicted for r in rows if r.toxic]) > 0.6


def test_toxicity_odd_rows(odd_docs, no_docs, small, unchanged):
    labels = small("labels")
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert toxicity.toxicity(no_docs, labels).isEmpty()
    assert {r.predicted for r in toxicity.toxicity(odd_docs, labels.limit(0)).collect()} == {0}
    assert unchanged(toxicity.keep_ordinary(odd_docs, labels)) and toxicity.keep_ordinary(no_docs, labels).isEmpty()


def plain_dictionary(own, other):
    """The marks of a class with sets of words alone."""
    sets, others = [[toxicity._starts(t) for t in c] for c in (own, other)]
    least, bar = max(toxicity.LEAST, toxicity.LEAST_SHARE * len(own)), toxicity.ODDS * (len(own) + 1) / (len(other) + 1)
    df = lambda w, c: sum(w in s for s in c)
    marks = {w for w in set().union(*sets) if df(w, sets) >= least and df(w, sets) + 0.5 >= bar * (df(w, others) + 0.5)}
    share, taken = [1.0] * len(own), []
    while marks and sum(map(len, taken)) < toxicity.DICTIONARY:
        gain = {w: sum(share[k] for k, s in enumerate(sets) if w in s) for w in marks}
        best = min(marks, key=lambda w: (-gain[w], -len(w), w))
        if gain[best] < least / 2:
            break
        taken.append(best)
        share = [x / 2 if best in s else x for x, s in zip(share, sets)]
        marks = {w for w in marks if not best.startswith(w)}
    return b"\n".join(reversed(taken))


def test_dictionaries_and_scores_equal_plain_ones(spark, monkeypatch):
    """Marks by sets of words; scores window by window with compressors made here."""
    monkeypatch.setattr(toxicity, "LEAST", 2)
    rng = np.random.default_rng(3)
    common = ["".join(rng.choice(list("etaoinsrh"), 7)) for _ in range(60)]
    make = lambda extra: [" ".join(list(rng.choice(common, 25)) + list(rng.choice(extra, 2))) for _ in range(30)]
    own, other = make(["grumblefitz", "nastyworts", "vilepudding"]), make(["kindlyword", "goodpudding"])
    a, b = [toxicity.Sample(t) for t in own], [toxicity.Sample(t) for t in other]
    toxic, ordinary = toxicity.learn_dictionary(a, b), toxicity.learn_dictionary(b, a)
    assert b"grumblefitz"[:9] in toxic and toxic == plain_dictionary(own, other) and ordinary == plain_dictionary(other, own)
    model = toxicity.Model(toxic, ordinary, (0.1, 0.2, 0.3, 0.4, 0.5), -1.0)
    rows = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate([*own[:5], *other[:5], "", None])), "doc_id int, text string"), model).collect()}
    for i, text in enumerate([*own[:5], *other[:5], "", None]):
        lengths = []
        for d in (toxic, ordinary):
            shape = zstandard.ZstdCompressionParameters.from_level(3, min_match=6, strategy=zstandard.STRATEGY_GREEDY, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
            c = zstandard.ZstdCompressor(compression_params=shape, dict_data=zstandard.ZstdCompressionDict(d + b"\n" + toxicity.PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            lengths.append([len(c.compress(toxicity.PRIMER + w)) for w in toxicity.windows(text or "")])
        saved = [max(0, o - t) for t, o in zip(*lengths)] or [0]
        strong = [max(0, x - toxicity.STRONG) for x in saved]
        x = np.log1p([20 * np.mean(saved), max(saved), sum(saved), 20 * np.mean(strong), sum(strong)])
        assert abs(rows[i] - 1 / (1 + np.exp(-(x @ np.array(model.weights) - 1.0)))) < 1e-9


def test_windows_hold_the_whole_text():
    for text in ("", "a", "word " * 500, "x" * 1000, "é" * 300):
        assert b"".join(toxicity.windows(text)).replace(b" ", b"") == text.lower().encode().replace(b" ", b"")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(odd_docs, no_docs, small):
    net = language_id.train(small("documents"))
    found = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(odd_docs, net).collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (11, "und", 0.0)} <= found
    assert all(lang in net.langs for i, lang, _ in found if i in (1, 6, 7, 9))
    assert language_id.language_id(odd_docs).count() == odd_docs.count()  # one language to learn
    assert language_id.language_id(no_docs).isEmpty()


def test_predictions_equal_a_plain_network(spark, small, monkeypatch):
    """Every text by itself, window by window, filter by filter."""
    monkeypatch.setattr(language_id, "TOGETHER", 7)
    docs = small("documents").limit(40)
    net, n = language_id.train(small("documents")), language_id.WINDOW
    for r in language_id.predict(docs, net).join(docs.select("doc_id", "text"), "doc_id").collect():
        data, total = r.text.lower().encode(), np.zeros(len(net.langs))
        for at in range(0, len(data), n):
            window = np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8)
            best = np.max([sum(net.tables[j][window[i + j]] for j in range(len(net.tables))) for i in range(n - len(net.tables) + 1)], axis=0)
            z = np.maximum(best + net.bias, 0) @ net.dense + net.dense_bias
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(data[at : at + n])
        assert r.lang_pred == net.langs[int(total.argmax())] and abs(r.score - total.max() / len(data)) < 1e-4


def test_training_text_is_spread_over_the_whole(spark):
    from rosterspark.llm.shared import pieces_over

    text = "".join(f"{i:05d}" for i in range(10_000))
    found = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(pieces_over(F.col("t"), 5, 100)).collect()
    parts = found[0][0].split("\n")
    assert [len(p) for p in parts] == [100] * 5 and text.startswith(parts[0]) and text.endswith(parts[-1]) and all(p in text for p in parts)
    assert found[1][0] == "short" and found[2][0] is None


def test_joined_tables_give_the_network():
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 123, (40, language_id.WINDOW)).astype(np.uint8), rng.integers(0, 2, 40)
    net = language_id.train_network(x, y, ("a", "b"))
    wide = len(net.tables)
    response = sum(net.tables[j][x[:, j : j + language_id.WINDOW - wide + 1]] for j in range(wide)).max(1) + net.bias
    expected = language_id._softmax(np.maximum(response, 0) @ net.dense + net.dense_bias)
    assert np.allclose(language_id.Predictor(net).windows(x), expected, atol=1e-4)
    assert language_id.windows("é" * 300)[1].sum() == 600


@pytest.mark.parametrize("n", [0, 1, 50])
def test_logistic_fit_is_finite(n):
    x = np.random.default_rng(0).normal(size=(n, 3))
    w, b = toxicity.fit_logistic(x, (x[:, 0] > 0).astype(float), np.ones(n))
    assert np.isfinite(w).all() and np.isfinite(b)
