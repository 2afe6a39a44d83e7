"""The segment model: held-out accuracy, exact inference, and its operator."""

import itertools
import json
import math

import pytest

from tessera.llm import pii, pii_train


def test_held_out_accuracy():
    precision, recall = pii_train.accuracy(pii.trained(), pii_train.examples(600, 99))
    assert precision > 0.97 and recall > 0.93


def test_frames_that_were_not_trained_on():
    rows = pii_train.examples(600, 98, pii_train.HELD, pii_train.HELD_PLAIN)
    precision, recall = pii_train.accuracy(pii.trained(), rows)
    assert precision > 0.97 and recall > 0.97
    precision, recall = pii_train.accuracy(pii.trained(), rows, exact=True)
    assert precision > 0.95 and recall > 0.95


NAMES = pii.Names(frozenset({"petra"}), frozenset({"novotna"}))


@pytest.mark.parametrize("address", ["221B Baker St, London NW1 6XE", "12 Baker Street, London, NW1 6XE", "145 Oak Avenue, Apt 12, Springdale", "8 bis, rue du Moulin, 75011 Rosenau", "Lindenallee 17a, 10115 Ebersfeld", "U Lesa 4/27, 718 60 Kostrov", "ul. Polna 21/46, 55-265 Novabor", "98 Harbour Road\nMillbeck 43210"])
@pytest.mark.parametrize("frame", ["Ship to {}.", "The parcel goes to {}, thanks.", "Bydliště: {}", "address={}; ok"])
def test_addresses_whole(address, frame):
    text = frame.format(address)
    assert pii.redact(text, pii.decode(pii.segments(text, NAMES), pii.trained())) == frame.format("[ADDRESS]")


@pytest.mark.parametrize("text", ["от {}", "Автор: {}, тел. +7 912 345-67-89", "Υπεύθυνος: {}", "հեղինակ՝ {}", "by {}", "联系人：{}", "담당자: {}", "מאת {}", "من {}"])
def test_names_in_scripts(text):
    name = {"о": "Иван Петров", "А": "Иван Петров", "Υ": "Νίκος Καράκης", "հ": "Արմեն Պետրոսյան", "b": "Petra Novotná", "联": "王建国", "담": "김민준", "מ": "יוסף כהן", "م": "أحمد الحداد"}[text[0]]
    found = pii.decode(pii.segments(text.format(name), NAMES), pii.trained())
    assert name in {text.format(name)[s.start : s.end] for s in found if s.kind == "name"}


@pytest.mark.parametrize("text", ["ip 192.168.10.24 is down", "Server 10.0.12.7 answers", "IBAN DE89 3704 0044 0532 0130 00 is no phone.", "Die Übersicht der Läufe fehlt.", "The Main Window opens.", "Build 2024.113.20 took 3 412 884 tokens.", "Задача закрыта. Таблица пуста.", "索引为空。", "هذا الجدول فارغ"])
def test_nothing_personal(text):
    assert pii.decode(pii.segments(text, NAMES), pii.trained()) == []


def test_long_runs_of_digit_groups():
    text = "call 01 23 45 67 89 " + "12 " * 40 + "tel. +33 6 12 34 56 78"
    assert any(text[s.start : s.end] == "+33 6 12 34 56 78" for s in pii.decode(pii.segments(text, NAMES), pii.trained()))


def test_weights_come_from_the_training():
    assert json.loads(json.dumps(pii_train.train())) == pii.trained()


def _all(found):
    """Every set of segments that don't overlap."""
    for n in range(len(found) + 1):
        for c in itertools.combinations(found, n):
            s = sorted(c, key=lambda x: x.start)
            if all(a.end <= b.start for a, b in zip(s, s[1:])):
                yield s


def test_inference_is_exact():
    S = pii.Segment
    found = [S(0, 4, "name", ["a"]), S(2, 6, "phone", ["b"]), S(4, 9, "name", ["c"]), S(0, 9, "address", ["d"]), S(6, 9, "email", ["a", "c"])]
    w = {"a": 1.0, "b": 1.7, "c": 0.4, "d": 1.3}
    score = lambda s: sum(w[f] for x in s for f in x.features)
    best = max(_all(found), key=score)
    assert pii.decode(found, w) == best
    total = math.log(sum(math.exp(score(s)) for s in _all(found)))
    gold = {(0, 4, "name"), (4, 9, "name")}
    likelihood, g = pii.gradient(found, gold, w)
    assert abs(likelihood - (score([found[0], found[2]]) - total)) < 1e-9
    for f in w:  # the gradient by differences
        up, down = ({**w, f: w[f] + d} for d in (1e-6, -1e-6))
        assert abs((pii.gradient(found, gold, up)[0] - pii.gradient(found, gold, down)[0]) / 2e-6 - g[f]) < 1e-5


PEOPLE = [("Søren", "Quarro", "x"), ("Elin", "Brandt", "y"), (None, None, "z")]


def _run(spark, rows):
    people = spark.createDataFrame(PEOPLE, "given string, family string, tbl string")
    df = spark.createDataFrame(rows, "tbl string, row_id string, text string, kinds string")
    return pii.scanned(df, people)


def test_operator(spark):
    rows = [
        ("c", "1", "Call Soren Quarro at +49 30 23125 006 or mail a.b+c@mail.example.org.", None), ("c", "1", "Call Soren Quarro at +49 30 23125 006 or mail a.b+c@mail.example.org.", None),
        ("c", "2", "E. Brandt lives at 12 Elm Street, Norhaven 12345; SSN 123-45-6789, twice 123-45-6789", None), ("c", "3", None, None), ("c", "4", "", None),
        ("c", "5", "Thanks Elin, works now. git@git.host.test:core/x.git, parser@1.2.3, build 2024.11.3 took 202.555 s on 192.0.2.1", None), ("c", "6", "x" * 300_000 + " me@host.example " + "1 " * 50_000, None),
    ]
    scans = _run(spark, rows)
    text = {r["row_id"]: r["redacted"] for r in scans.collect()}
    assert text["1"] == "Call [NAME] at [PHONE] or mail [EMAIL]." and text["3"] is None and text["4"] == "" and text["5"] == rows[5][2]
    assert text["2"] == "[NAME] lives at [ADDRESS]; SSN [ID_NUMBER], twice [ID_NUMBER]"
    items = sorted(tuple(r) for r in pii.items(scans).filter("row_id IN ('1', '2')").collect())
    assert items == [("c", "1", "email", 1), ("c", "1", "name", 1), ("c", "1", "phone", 1), ("c", "2", "address", 1), ("c", "2", "id_number", 1), ("c", "2", "id_number", 2), ("c", "2", "name", 1)]
    assert "[EMAIL]" in text["6"]


def test_more_names_than_are_broadcast(spark, monkeypatch):
    rows = [("c", str(i), t, None) for i, t in enumerate(["Call Soren Quarro today.", "Soren Quarro", None, "", "Elin Brandt and SØREN QUARRO met, Elin Brandt left."])]
    want = sorted(map(tuple, _run(spark, rows).select("row_id", "redacted").collect()), key=str)
    monkeypatch.setattr(pii, "BROADCAST_NAMES", 1)
    assert sorted(map(tuple, _run(spark, rows).select("row_id", "redacted").collect()), key=str) == want


def test_empty(spark):
    assert pii.items(_run(spark, [])).count() == 0
