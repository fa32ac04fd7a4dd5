import zlib

from lamella.llm import language_id as li
from lamella.llm.common import table


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: (r.lang, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = li.op7_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held) > 0.98
    assert sum(r.lang_rejected for r in rows) / len(rows) < 0.01
    again = {r.doc_id: r for r in li.op7_language_id(spark, "/root/testdata/sf0.01").collect()}
    assert all(again[r.doc_id] == r for r in rows)


def test_edges(spark):
    rows = [(i, "der die das und ist nicht ein wort " * 3, "de") for i in range(30)] + [(100 + i, "the and that is not one word of this " * 3, "en") for i in range(30)]
    rows += [(None, "the and that", "en"), (201, None, "en"), (202, "", None), (203, "12 !?", "en"), (204, "das und ist " * 20000, None), (204, "das und ist " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    got = li.predict(docs, li.fit(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[204].lang_pred == "de" and by[None].lang_pred == "en" and by[0].lang_pred == "de"
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].lang_rejected for i in (201, 202, 203))
    assert li.keep_identified(docs, li.fit(docs)).columns == docs.columns
    empty = li.fit(docs.limit(0))
    assert all(r.lang_pred == "und" for r in li.predict(docs, empty).collect()) and li.predict(docs.limit(0), empty).count() == 0


def test_letters_are_unicode_letters(spark):
    rows = [(i, "der die das und ist nicht ein wort " * 3, "de") for i in range(30)]
    docs = spark.createDataFrame([*rows, (50, "\u00b2 \u00bd \u2460 \u2167", None), (51, "\u00aa", None), (52, "\u4e2d", None)], "doc_id long, text string, lang string")
    by = {r.doc_id: r.lang_pred for r in li.predict(docs, li.fit(docs)).collect()}
    assert by[50] == "und" and by[51] == by[52] == "de"


def test_rejects_what_was_not_learned(spark):
    """Random letters and another script's language go, whatever the number of classes; clean rows stay."""
    import random

    rng = random.Random(4)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    odd = ["".join(rng.choice("qxzjkvwy") + rng.choice("bcdfghjkqxz ") for _ in range(150)) for _ in range(30)]
    odd += [" ".join("\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 \u043a\u043d\u0438\u0433\u0430".split()[rng.randrange(3)] for _ in range(40)) for _ in range(30)]
    for langs in (["en"], ["de", "fr"], None):
        learned = docs if langs is None else docs.where(docs.lang.isin(*langs))
        model = li.fit(learned)
        assert sum(model.predict(t.encode())[2] for t in odd) >= 0.95 * len(odd), (langs, model.known_below)
        kept = li.keep_identified(learned, model).count()
        assert kept >= 0.99 * learned.count()


def test_whole_texts_are_learned():
    """A long text's bag covers all of it."""
    text = "aaa " * 2000 + "zzz"
    whole = li.bags_of(text, 3)[0][0]
    assert set(li.subwords(b"zzz").tolist()) <= set(whole.tolist())
