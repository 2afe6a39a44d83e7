"""Round trips through wrong pages, and texts that must stay."""

import pytest

from tessera.llm import encoding as E

CLEAN = [
    "Žádný běh nesmí zůstat otevřený déle než 40 minut. Příliš žluťoučký kůň úpěl ďábelské ódy.", "Nejdřív načteme přehled běhů, potom seznam kritérií a nakonec obojí sloučíme.", "Die Prüfung läuft über acht Dateien und dauert ungefähr drei Größen länger.",
    "Le contrôle s’arrête dès que la fenêtre d’usage a été relu, même à l’aube — où ça ?", "Сначала читаем индекс объявлений, затем счётчик токенов и проверяем, что всё верно.", "Проверьте, что запись ведёт только один поток, и ещё раз прочитайте журнал.",
    "Proszę sprawdzić, czy zapis jest już gotowy; zostało jeszcze coś, co należy usunąć.", "Não há razão para chamar a função de ordenação duas vezes.", "The reviewer’s checklist – not the agent’s – holds “every” naïve café.",
] * 40


@pytest.fixture(scope="module")
def likely():
    counts = {}
    for t in CLEAN:
        for p in E.pairs(t):
            counts[p] = counts.get(p, 0) + 1
    return E.likelihood(counts)


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1250", "cp437", "cp850", "cp852", "cp1251", "mac_roman", "cp866"])
@pytest.mark.parametrize("text", sorted(set(CLEAN)))
def test_utf8_read_in_a_page_comes_back(likely, page, text):
    back = E.page(page)[1]
    wrong = "".join(back[b] if b > 127 else chr(b) for b in text.encode())
    assert E.repair(wrong, likely)[:2] == (True, text)
    assert E.repair(text[:20] + " " + wrong, likely)[:2] == (True, text[:20] + " " + text)


@pytest.mark.parametrize("text", sorted(set(CLEAN)))
def test_twice_wrong_comes_back(likely, text):
    back = E.page("cp1252")[1]
    for _ in range(2):
        wrong = "".join(back[b] if b > 127 else chr(b) for b in (wrong if "wrong" in locals() else text).encode())
    assert E.repair(wrong, likely)[1] == text


OTHER = [
    "日本語の文章をここに書きます。東京は大きいです。", "שלום עולם, זה מבחן של טקסט", "مرحبا بالعالم هذا نص للاختبار", "สวัสดีชาวโลก นี่คือการทดสอบ", "안녕하세요 세계, 이것은 시험입니다", "你好，世界。这是一个测试。", "नमस्ते दुनिया यह परीक्षण है",
    "Ελληνικό κείμενο για δοκιμή", "Հայերեն տեքստ", "ქართული ტექსტი", "Việt Nam là một đất nước đẹp", "Привіт, світе! Це їжак", "Ștefan și țară",
]


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "cp1250", "cp437", "cp850", "koi8-r", "mac_roman", "iso8859-15"])
@pytest.mark.parametrize("text", OTHER)
def test_scripts_the_corpus_lacks_come_back(likely, page, text):
    assert E.repair(text, likely)[:2] == (False, text)
    back = E.page(page)[1]
    wrong = "".join(back[b] if b > 127 else chr(b) for b in text.encode())
    assert E.repair(wrong, likely)[:2] == (True, text)


@pytest.mark.parametrize("text", [CLEAN[0], OTHER[0], OTHER[7]])
@pytest.mark.parametrize("times", [3, 5, 7])
def test_often_wrong_comes_back(likely, text, times):
    back, wrong = E.page("latin-1")[1], text
    for _ in range(times):
        wrong = "".join(back[b] if b > 127 else chr(b) for b in wrong.encode())
    assert E.repair(wrong, likely)[1] == text


@pytest.mark.parametrize("text", ["только один поток, запись ведёт", "Nejdřív načteme, dříve", "├──────┼───────┤", "ТОЛЬКО тОЛЬКО"])
def test_right_words_that_are_well_formed_by_chance_stay(likely, text):
    assert not E.repair(text, likely)[0]


@pytest.mark.parametrize(("truly", "read", "n"), [("cp1250", "cp1252", 0), ("cp1251", "cp1252", 4), ("koi8-r", "cp1251", 4), ("cp852", "cp1250", 1)])
def test_swapped_pages(likely, truly, read, n):
    text = CLEAN[n]
    there, back = E.page(truly)[0], E.page(read)[1]
    wrong = "".join(back[there[c]] if c in there else c for c in text)
    garbled, new, causes = E.repair(wrong, likely)
    assert garbled and new == text


@pytest.mark.parametrize("text", [
    *CLEAN[:9], "", "plain ascii", "It prints “Ã©” where “é” was typed.", "U+FFFD (�) stands for lost bytes.", "│ run │ turns │\n├─────┼──────┤\n│ 12 │ 40 │", "Footer: © ® ™ § ¶ « » ¿ ¡ — Ł Ø Æ ß þ ð are kept.", "ÉTÉ À NOËL : ÇA VA", "NÃO É ATÉ À VERSÃO", "Ангстрем Å, ±2°, µs, Δ ≤ 3 ✓ 😀",
])
def test_right_texts_stay(likely, text):
    assert E.repair(text, likely)[:2] == (False, text)


def test_lost_bytes_are_found(likely):
    assert E.repair("Zůst�v� otázka, the session�s end, hour � not day", likely)[0]


def test_operator(spark):
    rows = [(i, t, 0) for i, t in enumerate(CLEAN)] + [(900, "Donâ€™t call it, cafÃ©", 0), (901, None, 0), (902, "", 0), (903, "the cafÃ© " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, garbled int")
    out = {r["doc_id"]: r for r in E.repaired(df).filter("garbled").collect()}
    assert set(out) == {900, 903} and out[900]["restored"] == "Don’t call it, café" and out[903]["restored"] == "the café " * 50_000
    assert E.repaired(df.limit(0)).count() == 0


def test_a_frequent_garbling_stays_garbled(spark):
    back = E.page("cp1252")[1]
    wrong = lambda t: "".join(back[b] if b > 127 else chr(b) for b in t.encode())
    words = "Prüfung läuft über größere Flächen, für höhere Ströme müßte später jährlich geprüft werden".split()
    texts = [f"{i} " + " ".join(words[i % 7 :] + words[: i % 7]) for i in range(60)]
    copies = [(i, wrong(texts[0])) for i in range(300)]  # one text over and over
    source = [(1000 + i, wrong(t)) for i, t in enumerate(texts)]  # different texts, all garbled
    right = [(2000 + i, t) for i, t in enumerate(sorted(set(CLEAN)))] + [(3000 + i, f"{i} её ещё объём, чётко её пёс") for i in range(20)]
    df = spark.createDataFrame(copies + source + right, "doc_id bigint, text string")
    out = {r["doc_id"]: r["restored"] for r in E.repaired(df).filter("garbled").collect()}
    assert set(out) == {i for i, _ in copies + source}
    assert out[0] == texts[0] and all(out[1000 + i] == t for i, t in enumerate(texts))


def test_copies_count_once(spark):
    df = spark.createDataFrame([(t,) for t in ["á é"] * 5 + ["á"]], "text string")
    assert E.model(df) == {" á": 2, "á ": 2, " é": 1, "é ": 1}
