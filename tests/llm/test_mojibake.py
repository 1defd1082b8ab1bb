import pytest

from loomqa.llm import mojibake as M

CLEAN = [
    "It wasn’t the parser but the café – “naïve”… at 28 °C.", "El médico todavía explica la estación, aunque la reseña esté así: ¿cómo?", "A LIÇÃO NÃO AVALIA O ÍNDICE. O MÉDICO JÁ ESTÁ.",
    "La città è così, perché la qualità non c’è più.", "LA FORÊT RÉVISE LA DURÉE DÈS QUE LE RELEVÉ A ÉTÉ CONTRÔLÉ.", "Die Größe der Brücke bleibt gültig, außerdem größer.", "Уже 18 недель местный отчёт описывает рынок и каждый архив.",
    "УЖЕ 18 НЕДЕЛЬ МЕСТНЫЙ ОТЧЁТ ОПИСЫВАЕТ РЫНОК. Пётр всё ещё здесь.", "日本語の要約 １２３ 👩‍🔬🙂", "שלום עולם", "αβγ ∑ x² ≤ π", "© Ninth Shelf – all notes", "ééééééé", "á é ë", "plain ASCII &amp; &#39;text&#39;", "",
]
WRONG = [("cp1252", True), ("latin-1", True), ("mac_roman", True), ("cp437", True), ("cp1251", True)]


@pytest.mark.parametrize("text", CLEAN)
def test_correct_text_is_no_case(text):
    assert M.repair(text) == (False, False, text)


@pytest.mark.parametrize("encoding,_", WRONG)
@pytest.mark.parametrize("text", CLEAN[:6])
def test_utf8_read_in_another_encoding(text, encoding, _):
    raw = text.encode("utf-8")
    wrong = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in raw)
    assert M.repair(wrong) == (True, True, text)


def test_twice_and_in_part():
    once = "café – naïve".encode().decode("cp1252")
    twice = once.encode("utf-8").decode("cp1252", "replace")
    assert M.repair("Fine text, é. " + once + "!")[2] == "Fine text, é. café – naïve!"
    assert M.repair(twice)[2] == "café – naïve"
    assert M.repair("caf&#195;&#169; x")[2] == "café x"


def test_cyrillic_encodings_taken_for_each_other():
    text = "Поэтому журнал всё ещё учитывает каталог, хотя мост изменился."
    for a, b in (("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp1252")):
        assert M.repair(text.encode(a).decode(b, "replace"))[::2] == (True, text)


def test_lost_bytes_are_reported_but_not_restored():
    assert M.repair("It wasn�t")[:2] == (True, False)


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, None, True), (2, "", True), (3, "cafÃ©", True), (3, "cafÃ©", True), (4, "ok", True), (5, "Ã©" * 20000, True)], "doc_id long, text string, restored boolean")
    got = sorted((r.doc_id, r.restored, r.original[:4]) for r in M.find_garbled(df, "doc_id", "text").collect())
    assert got == [(3, True, "café"), (3, True, "café"), (5, True, "éééé")]
    assert M.find_garbled(df.limit(0), "doc_id", "text").count() == 0


SOUND = [
    "Жюль Щуцкий эффект", "ФСБ и ФБР: шеф юриста Цуцуев", "Її щастя — це їжа й щедрість.", "Чуєш їх, брате мій, ґедзь її є.", "CÔTÉ ÉTÉ DÉÇÀ", "GRÖßE ÜÄÖ", "Søren ÆØÅ æøå", "ÅÄÖ åäö ÄÖÅ", "PAMÄŤ", "caf&eacute;", "一些联通",
]


@pytest.mark.parametrize("text", SOUND)
def test_hard_sound_text_stays(text):
    assert M.repair(text) == (False, False, text)


def test_no_sound_sentence_in_many_languages_is_changed(spark):
    """24,000 sentences made of the names of countries, languages and currencies in the JVM's locale data."""
    import random

    j, rng = spark._jvm.java.util, random.Random(5)
    countries, currencies = list(j.Locale.getISOCountries()), list(j.Currency.getAvailableCurrencies())
    for tag in "ru uk bg sr be de sv pl cs sk el ar hi th zh ja".split():
        here = j.Locale.forLanguageTag(tag)
        names = {j.Locale("", c).getDisplayCountry(here) for c in countries} | {c.getDisplayName(here) for c in currencies}
        names = sorted(n for n in names if not n.isascii())
        for _ in range(1500):
            text = " ".join(rng.sample(names, rng.choice((1, 2, 3, 6, 10))))
            text = rng.choice((str, str, str, str.upper, str.lower))(text)
            assert M.repair(text) == (False, False, text)


@pytest.mark.parametrize("wrong,right", [
    ("Ã&copy;", "é"), ("caf&Atilde;&copy;", "café"), ("caf&amp;Atilde;&amp;copy;", "café"), ("縺薙ｓ縺ｫ縺｡縺ｯ", "こんにちは"), ("中文".encode().decode("gb18030"), "中文"), ("Ïðèâåò, ìèð", "Привет, мир"),
])
def test_entities_and_multi_byte_encodings(wrong, right):
    assert M.repair(wrong) == (True, True, right)


def test_replacement_characters_read_in_gbk_are_lost():
    assert M.repair("锟斤拷锟斤拷")[:2] == (True, False)


def test_many_steps_have_no_budget():
    text = "São João – “naïve” café"
    wrong = text
    for _ in range(6):
        wrong = wrong.encode("utf-8").decode("latin-1")
    assert M.repair(wrong) == (True, True, text)


def test_a_short_sentence_beside_garbled_ones_is_read_like_them():
    text = "НОВЫЙ РЫНОК. Поэтому журнал всё ещё учитывает каталог, хотя мост изменился."
    assert M.repair(text.encode("koi8-r").decode("cp1251"))[2] == text
