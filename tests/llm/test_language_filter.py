"""Which documents the language stage lets through."""

from __future__ import annotations

import pytest

from spendwarden.llm import lang_crf

POLISH = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
          "Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych przekonań, "
          "narodowości, pochodzenia społecznego, majątku, urodzenia lub jakiegokolwiek innego stanu. Nie wolno ponadto czynić żadnej różnicy w zależności od sytuacji politycznej, prawnej lub "
          "międzynarodowej kraju lub obszaru, do którego dana osoba przynależy. ")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return lang_crf.train(docs)


def kept(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k0 bigint, text string").selectExpr("k0", "text", "'x' as lang_pred", "true as `foreign`")
    out = lang_crf.known_only(df, model)
    assert out.columns == df.columns
    return sorted(r["k0"] for r in out.collect())


def test_documents_stay_and_unlearned_languages_go(spark, docs, model):
    some = {g: [r["text"] for r in docs.where(f"lang = '{g}' and n_chars between 1500 and 3000").orderBy("doc_id").limit(3).collect()] for g in model.labels}
    mixed = [" ".join(t[0][:700] for t in some.values()), "\n".join(t[1][:400] for t in list(some.values())[:2])]  # evenly of four and of two languages
    short = ["Edrere.", "ª", some[model.labels[0]][2][:40]]
    texts = [*(x for t in some.values() for x in t), *mixed, *short]
    away = [POLISH * 2, POLISH.upper(), None, "", "12 34 !! ...", "\n"]
    got = kept(spark, model, texts + away)
    assert got == list(range(len(texts)))
    odd = spark.createDataFrame([(1, "ª"), (2, "12"), (3, None)], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in lang_crf.predict(odd, model).collect()) == [(1, model.labels[0], 0.0), (2, "und", 0.0), (3, "und", 0.0)]


def test_all_documents_with_letters_stay(docs, model):
    some = docs.where("text rlike '[A-Za-z]'")
    assert lang_crf.known_only(some, model).count() >= 0.999 * some.count()


def test_the_number_of_languages_plays_no_part(spark, docs, model):
    few = lang_crf.train(docs.where("lang in ('en', 'de')"))
    evenly = " ".join(docs.where(f"lang = '{g}' and n_chars > 1500").orderBy("doc_id").first()["text"][:1200] for g in ("en", "de"))
    assert kept(spark, few, [evenly, POLISH * 2]) == kept(spark, model, [evenly, POLISH * 2]) == [0]
    assert kept(spark, None, [evenly]) == []
