"""python -m tessera.llm.pii_train: fits the weights of `pii` to generated sentences and writes them beside it.

The sentences are made here from a seed: shapes of entities are drawn by rule, names from syllables, so that no real or test
data goes into the weights. A share of the names is unknown to the list, as in real texts. `HELD` frames are never trained on.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from pathlib import Path

from tessera.llm.pii import Names, decode, fit, fold, segments

ROWS = 12_000  # sentences fitted to: the bound of the labelled sample
LEAST = 6  # sentences that must have a feature

GIVENS = "Adela Bruno Carla Denis Edita Felix Gerda Henrik Ilona Jakub Karin Lars Mirela Nils Olga Pascal Renée Stefan Tilda Uwe Věra Walter Xenia Zdeněk".split()
STEMS, ENDS = "Bor Cal Dev Fen Gar Hol Jor Kav Lom Mar Nor Pel Rud Sel Tor Vam".split(), "ana ek er es ick ilova man ner ová ský son tin uk vall".split()
#: (letters of given names' syllables, letters of family names' syllables and ends) of scripts with capitals, and of scripts without.
CASED = {
    "ru": ("Ан Бо Ви Гри Де Ми Ро Та".split(), "рис на вел лия дор ша".split(), "Вор Гал Кар Лит Мор Нов Пет Сав Тар".split(), "ов ин енко ский ова ина".split()),
    "el": ("Αν Βα Γε Δη Ελ Νι Σο".split(), "νας λης κος ρία νη".split(), "Βασ Γαλ Καρ Λαμ Μορ Νικ Παπ".split(), "άκης όπουλος ίδης ος ου".split()),
    "hy": ("Ար Գա Դա Լի Մա Սու".split(), "մեն գիկ նի րեն սան".split(), "Պետ Սարգ Հակ Մար Գր".split(), "րոսյան սյան ոբյան տիրյան".split()),
}
CASELESS = {
    "he": ("אב דו יו מש רו שר".split(), "רהם יד סף ה ן ית".split(), "כה לו בן מז פר".split(), "ן י ר חי ץ".split(), " "),
    "ar": ("أح مح سع يو خا فا".split(), "مد مود يد سف لد طمة".split(), "الح الم الس الن".split(), "داد صري عيد جار".split(), " "),
    "ko": ("김 이 박 최 정".split(), "", "민 서 지 하 도".split(), "준 연 우 윤 현".split(), ""),
    "zh": ("王 李 张 刘 陈".split(), "", "小 建 丽 志 文".split(), "明 国 华 芳 强".split(), ""),
}
STREETS = "Oak Pine Harbour Castle Garden North Long Upper Bridge Church Baker Queen Meadow Orchard Spring Hill Lake Park Sunset Maple".split()
KINDS_OF_STREET = "Street Road Lane Avenue Drive Court Square Boulevard Terrace Close Way St. Rd. Ave. St Rd Ave Ln Dr Blvd".split()
TOWNS = "Altmoor Fernbridge Havelin Kostrov Millbeck Novabor Port-Garen Rosenau Turnovec Westerly Lower-Holm Ebersfeld Sant-Orso Krasnov Vellby".split()
TWO_WORD_TOWNS = "Great Yarrow|New Haldon|San Orso|Bad Rosenau|Nowy Kostrov|Saint Garen".split("|")


def _made(r: random.Random, *parts: list) -> str:
    return "".join(r.choice(p) for p in parts if p)


def _family(r: random.Random) -> str:
    return r.choice(STEMS) + r.choice(("", "a", "en", "il")) + r.choice(ENDS)


def _given(r: random.Random) -> str:
    return r.choice(GIVENS) if r.random() < 0.5 else r.choice(STEMS)[:3] + r.choice("a e i o".split()) + r.choice("n la rik na s do mir".split())


def _name(r: random.Random) -> str:
    g, f = _given(r), _family(r)
    if r.random() < 0.05:
        f += "-" + _family(r)
    form = r.random()
    if form < 0.46:
        out = f"{g} {f}"
    elif form < 0.64:
        out = f"{g[0]}. {f}"
    elif form < 0.8:
        out = f"{f}, {g}"
    elif form < 0.86:
        out = f"{g} {r.choice('ABDEHKMT')}. {f}"
    elif form < 0.9:
        out = f"{g} {_given(r)} {f}"
    elif form < 0.94:
        out = f"{g} {r.choice(('van', 'von', 'de', 'van der', 'da', 'di'))} {f}"
    elif form < 0.97:
        out = f"{f}, {g[0]}."
    else:
        out = f"{g[0]}.{r.choice(('', ' '))}{r.choice('ABDEHKMT')}. {f}"
    return out.upper() if r.random() < 0.1 else out


def _name_of(r: random.Random, script: str) -> str:
    if script in CASED:
        a, b, c, d = CASED[script]
        return f"{_made(r, a, b)} {_made(r, c, d)}"
    a, b, c, d, gap = CASELESS[script]
    return _made(r, a, b) + gap + _made(r, c, d)


def _email(r: random.Random) -> str:
    local = fold(r.choice((_family(r), _given(r) + r.choice(".-_+") + _family(r), _family(r) + str(r.randrange(100)))))
    host = r.choice(("mail.sample.org", "sample.net", "team.site.test", "post.sample.com"))
    form = r.random()
    if form < 0.7:
        out = f"{local}@{host}"
        return out.upper() if r.random() < 0.1 else out
    return f"{local} ({r.choice(('at', 'AT', 'zavináč'))}) {host}" if form < 0.8 else f"{local}[at]{host.replace('.', '[dot]')}" if form < 0.9 else f"{local} at {host.replace('.', ' dot ')}"


def _digits(r: random.Random, shape: str) -> str:
    return "".join(r.choice("123456789") if c == "N" else r.choice("0123456789") if c == "n" else c for c in shape)


def _filled(r: random.Random, sentence: str) -> str:
    """A plain sentence with its numbers drawn: N and n outside words are digits, {T} a made-up word with a capital, {t} one without, {K} two without case."""
    while "{T}" in sentence:
        sentence = sentence.replace("{T}", _noun(r), 1)
    while "{t}" in sentence:
        sentence = sentence.replace("{t}", _noun(r).lower(), 1)
    while "{K}" in sentence:
        sentence = sentence.replace("{K}", _name_of(r, r.choice(("he", "ar"))), 1)
    return re.sub(r"(?<![^\W\d_])[Nn]+(?![^\W\d_])", lambda m: _digits(r, m[0]), sentence)


def _noun(r: random.Random) -> str:
    out = r.choice("Ab Ber Dat Ein Fol Gru Ko Lis Mel Pro Re Ser Spei Ta Ver Zu".split()) + r.choice("al be cher der ge le li pe se ta wer".split()) + r.choice(("", "e", "en", "er", "ing", "k", "n", "s", "t", "tung", "ung"))
    return out


PHONES = "+49 Nn Nnnnn nnn|+44 Nnnn nnnnnn|+1 Nnn nnn nnnn|+1-Nnn-nnn-nnnn|+1Nnnnnnnnnn|+33 N nn nn nn nn|+33.N.nn.nn.nn.nn|+420 Nnn nnn nnn|+44 (0)Nn nnnn nnnn|+49 (0)Nnn nnnnnnn|00Nn-Nn-Nnnnn-nnn|0Nnnn nnn nnn|0Nn nnnn nnnn|(Nnn) nnn-nnnn|Nnn.nnn.nnnn|Nnn-nnn-nnnn|1-800-Nnn-nnnn|0N.nn.nn.nn.nn|+7 Nnn nnn-nn-nn|+86 1nn nnnn nnnn|+972 Nn nnn nnnn".split("|")


def _phone(r: random.Random) -> str:
    return _digits(r, r.choice(PHONES))


def _id(r: random.Random) -> str:
    passport = r.choice("ABCDE") + r.choice("XYZ")
    cue, bar, shape = r.choice((
        "Nnn-nn-nnnn", "Nnnnnn/nnnn", "Nnnnnn/nnn", "SSN |Nnnnnnnnn", "SSN |Nnn-nn-nnnn", "SSN: |Nnnnnnnnn", f"passport |{passport}nnnnnnn", f"passport no. |{passport[0]}nnnnnnn", "ID card no. |nnn nnn nnn", "ID card |Nnnnnnnnn",
        "identity card |Nnn nnn nnn", "Reisepass |CXnnnnnnn", "rodné číslo |Nnnnnn/nnnn", "social security number |Nnn-nn-nnnn", "birth number |Nnnnnn/nnnn",
    )).rpartition("|")
    return cue + bar + _digits(r, shape)


def _address(r: random.Random) -> str:
    n, town = str(r.randrange(1, 250)), r.choice(TOWNS) if r.random() < 0.85 else r.choice(TWO_WORD_TOWNS)
    join = r.choice((", ", ", ", "\n"))
    form = r.random()
    street = f"{n}{r.choice(('', '', '', 'a', 'B'))} {r.choice(STREETS)}{r.choice(('', '', ' ' + r.choice(STREETS)))} {r.choice(KINDS_OF_STREET)}"
    if form < 0.3:
        rest = r.random()
        return f"{street}, {r.choice(('Apt', 'Apt', 'Suite', 'Unit', 'Flat'))} {r.randrange(1, 50)}, {town}" if rest < 0.25 else f"{street}, {town}" if rest < 0.35 else f"{street}{join}{town}{r.choice((' ', ', '))}{_digits(r, 'Nnnnn')}"
    if form < 0.42:
        return f"{street}{join}{town}{r.choice((' ', ', '))}{r.choice(('NW', 'SE', 'M', 'LS', 'B'))}{r.randrange(1, 30)} {_digits(r, 'N')}{r.choice(('AB', 'XE', 'QT', 'JL'))}"
    if form < 0.6:
        return f"{n}{r.choice(('', '', ' bis,', ' ter,'))} {r.choice(('rue de la', 'rue', 'avenue du', 'rue des', 'place de', 'quai du', 'chemin des', 'boulevard'))} {r.choice(('Gare', 'Moulin', 'Roses', 'Basse', 'Grande', 'Port', 'Lac'))}{join}{_digits(r, 'Nnnnn')} {town}"
    noun = _noun(r)
    if form < 0.78:
        street = r.choice((f"{noun}straße", f"{noun}weg", f"{noun}str.", f"{noun}allee", f"{noun}platz", f"{noun}gasse", f"{noun}ufer", f"{noun}damm", f"{noun}strasse", f"{noun}ring", f"Am {noun}", f"Im {noun}", f"Zum {noun}", f"An der {noun}", f"Auf dem {noun}", f"{noun}er Straße", f"Kleine {noun}"))
        return f"{street} {n}{r.choice(('', 'a', 'b'))}{join}{r.choice(('', '', 'D-'))}{_digits(r, 'Nnnnn')} {town}"
    street = r.choice((f"{noun}ní", f"{noun}ová", f"{noun}ská", f"{noun}á", f"U {noun}a", f"Na {noun}u", f"Nad {noun}ou", f"Pod {noun}em", f"Za {noun}em", f"V {noun}u", f"náměstí {noun}", f"ul. {noun}a", f"ul. {noun}owa", f"al. {noun}a", f"ulica {noun}a", f"tř. {noun}a"))
    if form < 0.96:
        return f"{street} {n}{r.choice(('/' + str(r.randrange(1, 90)), '/' + str(r.randrange(1, 90)), ''))}{join}{_digits(r, r.choice(('Nnn nn', 'Nn-nnn')))} {town}"
    return f"{r.choice(('Via Roma', 'Kerkstraat', 'Calle Mayor', 'Dorpsweg'))} {n}{join}{_digits(r, r.choice(('Nnnn AB', 'Nnnnn')))} {town}"


MAKE = {"name": _name, "email": _email, "phone": _phone, "id_number": _id, "address": _address}
MAKE |= {f"name_{x}": (lambda r, x=x: _name_of(r, x)) for x in (*CASED, *CASELESS)}
#: Sentences with the places of entities in braces; N and n stand for digits where no entity is.
FRAMES = (
    "Please send it to {email} today.", "The owner is {name}, phone {phone}.", "Contact: {email} / {phone}", "{name} <{email}> wrote this", "Kontakt: {email}, {phone}.", "Reply to {name} ({phone}) first.",
    "{name} found it and told {name} about it.", "assigned by {name} to {name}", "Best wishes,\n{name}", "Regards, {name}", "Das kam von {name}, Tel. {phone}", "Zapsal {name}, číslo dokladu {id_number}.", "ticket of {name}",
    "The parcel goes to {address}.", "{name} lives at {address}, and it rains.", "Wohnhaft {address}; Ausweis {id_number}", "row: {name};{email};{phone};{address}", "record: {name} / {id_number} / {address}.",
    "Moved from {address} to {address} last year.", "The check rejects {id_number} here", "Purge {id_number} and {id_number} from it.", "tel={phone} user={email}", "fax {phone}, desk {phone}", '{"owner": "{name}", "doc": "{id_number}"}',
    "mailto:{email} is wrong", "Old value {phone}, new value {phone}.", "call back {phone} about it", "Ask {name} before noon. The Cache Reader is next.", "Error at {name} now", "from: {email} to: {email}", "as {name} noted, nothing is lost",
    "drop {phone} from the list", "úkol od {name}", "{email} cannot log in", "why does {id_number} pass", "address {address} breaks", "cc {email}; {email}", "continue what {name} began", "test with owner={email}",
    "{T} {name} is here.", "{T} {name}, {phone}", "Herr {name} wartet.", "Paní {name} volala.", "{T} {address}", "{T}: {address}", "The {T} of {name}", "{T} von {name}", "{T} {name_ru}", "{T} {name_el}", "Кто {name_ru}?", "{T}: {name_he}", "{T}: {name_ar}", "by {name}", "from {name}, {email}", "Thanks,\n{name}", "{T}, {name} and {name}", "{T}: {name}",
    "{T} {t} {address}", "{t} {t} {address}.", "{T} {t} {t}: {address}", "{t} {address} {T} {t}", "{T} na {t} {address}.", "work on ABC-Nnnn - {name}: {t} {t}", "ABC-Nnnn - {t} {id_number} {t}", "{t} {t} {id_number} and {email} {t}", "{t} {id_number} and {phone}", "{t} {id_number} {t} {t}", "{name}: {t} {t} {t}", "{t} {t} - {name}", "{name} – {t}", "מאת {name_he} {t}", "من {name_ar}.", "담당자 {name_ko} {t}",
    "Bydliště: {address}", "Adresse: {address}", "Letters for {name} at {address}, please.", "Write to {address}", "Invoice to {address} instead of {address}.", "Lieferung an {address} bitte", "Domicilié au {address}.", "we met {name} and {name} there", "Žádost podal {name}, telefon {phone}, chce vrátit zboží.",
    "Volal {name}, {phone}.", "Anruf von {name}: {phone}", "WhatsApp {phone}", "mobile {phone}", "Handy: {phone}", "signed-off-by: {name} <{email}>", "author: {name}", "cc {name}, {name}", "Hlásí {name}: nejde to.", "Fehler bei {name} prüfen", "pair with {name} on Friday", "after the call with {name} we stop",
    "owner: {name}, {email}", "missed {id_number} and {id_number} in one line", "test account {id_number}, ignore", "passed on by {name}. It works.", "deliver to {name}, {address}, phone {phone}", "s týmem to převezme {name}.", "napsala {name} včera", "Ticket von {name} übernommen", "{name} has it", "for {name} only",
    "от {name_ru}", "Автор: {name_ru}, тел. {phone}", "Звонил {name_ru}, просил перезвонить.", "Посылка для {name_ru} пришла.", "Вчера {name_ru} написал письмо.", "Γράφει ο {name_el} σήμερα", "από {name_el}", "Υπεύθυνος: {name_el}, {email}", "Գրել է {name_hy} այսօր", "հեղինակ՝ {name_hy}",
    "מאת {name_he}", "שם: {name_he}, {phone}", "من {name_ar}", "الاسم: {name_ar}، {phone}", "담당자: {name_ko}, {phone}", "작성자: {name_ko}", "联系人：{name_zh}，{phone}", "姓名：{name_zh}", "作者：{name_zh}",
)
PLAIN = (
    "The Cache Reader and the Page Writer differ.", "Thanks Bruno, works now.", "Main Road is a data set.", "Broad Avenue View and Post Box are later.", "Cost rose from N nnn nnn to N nnn nnn tokens.", "Mean Nnn.nnn s, worst Nnn.nnn s.",
    "Ratio nn.nn to nn.nn, spread 0.nnn.", "Seen at Nnnnnnnnnn and again at Nnnnnnnnnnnnn (epoch).", "Range Nnnnnnnnn to Nnnnnnnnn is reserved.", "Build 2024.Nnn.nn on agent 10.0.2.nn.", "Took Nnn-nnn-nn as the version.", "Took Nnn-nnn-nnn as the version.",
    "clone git@git.site.test:core/tool.git again", "Pinned to reader@1.N.n, was reader@2.N.n.", "Lane Nn, road map QNn.", "Fields Nnn/nnnn and N/nnn are empty.", "See page Nnn/nnn of the report.", "Ping @adelatorek for it.", "Merge Request Nn is open.",
    "Commit Nannnbn broke it.", "Request id Nnnnnnna-nnnn-4nnn-annn-nnnnnnnnnnnn timed out.", "Set PHONE_MASK and NAME_MASK first.", "Telephone page is off by Nnn px.", "Passport page fails to load.", "Die Anzeige ist leer. Das Feld fehlt.", "Úkol ABC-Nnnn říká, že seznam má Nnnn řádků.",
    "Für ABC-Nnn genügt es.", "Es waren Nnn Zeilen.\nWenn das Feld fehlt, geht es.", "Statt Nn waren es Nnn Einträge. Das Feld fehlt.", "It took Nnn Steps,\nThen it stopped.", "Nn Units Left, Nobody cares.", "Read Page Nn, Nnnn Words long.", "@Override is missing on line Nnn-nnn.", "See cursor/PageReader.java:Nnn for it.", "Since N.nn.n the list is sorted.", "The Reader logs Nnnnn rows, Nnn files.", "Took 0.Nnn s, then Nnn.nnn.nnn s", "Address 0xNnnafncn is not aligned.", "Look at sample.org for Nnnnn ms.",
    "ip 192.168.Nn.Nn is down", "from 10.Nn.Nn.Nnn to 172.16.Nn.N", "Server 203.0.113.Nn answers", "IBAN DENn Nnnn nnnn nnnn nnnn nn is no phone.", "Konto GBNn ABCD Nnnn nnnn nnnn nn", "Card Nnnn nnnn nnnn nnnn was refused.", "ISBN 978-N-nn-nnnnnn-n", "Order Nnnnnnnnnn of Nnn items", "Release N.nn.n, Build Nnnn, Version Nn", "Since 5.Nn.n the Table has Nnn rows, Column Nn too.",
    "It returned Nnn of Nnnn Entries,\nThe rest is lost.", "Ve verzi N.n.n přibyla volba, Tabulka Nn zmizela.", "When a stale index has Nnn rows, Nobody sees it.", "Nach Nnn Zeilen, Spalte Nn, bricht es ab.", "Funkce Reader vrací Nnn, Tabulka ne.", "Nnn ms, Nnnn ms and Nnnnn ms, Thread Nn waits", "On Page Nn, Line Nnn, Column Nn", "Session Nnnnnnn-nnn ended.", "Ticket KTL-Nnnn and LAN-Nnnn are one.", "Nn Old Tables, New Index", "Das Ergebnis war größer als erwartet: Nnn statt Nnnnn Einträge.",
    "{T} {T} fehlt.", "{T} {T} is open.", "{T} {T}, {T} {T}", "Der {T} {T} ist leer.", "die {T} der {T} fehlt", "das {T} des {T} ist alt", "Wenn die {T} des {T} fehlt, geht es.", "{T} der {T}", "{T} und {T} sind eins.", "Die {T} {T}", "Das {T}", "Der {T} {T} von {T}", "{T} {T} and {T} {T} are out.", "in {T} {T} nothing works", "Thanks {T}, works.",
    "We open {T} {T} now", "Laut {T} {T}", "Open {T} {T}, then {T} {T}.", "{T} nach {T}", "Cells Nnn/nnnn and N/nnn stay empty.", "Cell Nnnn/nnn, Row NN/nnnn", "No. Nnnnnn of Nnnnnnn rows", "{T} de {T}", "{T} di {T}", "{T}, {T} and {T}", "{T} A. {T}", "see {T}, {T}", "{K}", "{K} {K}", "{K}, {K}.", "{K} {T}", "id NnnnnnN, Nnnnnnnnn bytes", "{T} Nn, {T} Nnn, {T}", "{T} Nnn, Nnnnn {T}", "We saw {T} Nn, {T} too.", "On {T} Nn, Nnnn {T} were lost.",
    "{T} {T}: {T} {T}, {T} {T}.", "{T}: {T} {T}.", "ABC-Nnnn - {T} {T}: {t} {t}", "{T} {t} {T} Nnn, Nnnnn {T}", "{T} {t} {t}: {T} {T} {t}", "{t} {T} {T} {t} {t}", "{T} {T} {t} {t} {T}.", "the {T} {T} of {T}", "und {T} {T} {t}", "a {T} {T} {t} {t}", "Host 10.N.nn.nn {t}", "10.Nn.N.N and 10.nn.Nn.Nn {t}", "Nnn.nn.Nn.nn", "{K} {K}", "{K}", "{K} {K} {K}",
    "The Main Window opens. Upper Bar is grey.", "Pull Request Review, then Build Page", "Unit Tests Pass, Integration Tests Fail", "Error Code, Line Number", "First Name, Last Name", "Given Name and Family Name are required.", "Street Name, House Number, Town", "Phone Number Field", "E. g. this, I. e. that", "Step A. Then Step B.", "Option B. Works too.", "Plan A. Fine.",
    "Сначала читаем таблицу, потом индекс.", "Задача ABC-Nnn закрыта. Таблица Nn пуста.", "Если поле пустое, всё верно.", "Ο Πίνακας έχει Nnn γραμμές.", "Πρώτα το Ευρετήριο, μετά ο Πίνακας.", "Նախ աղյուսակը, հետո ինդեքսը։", "השדה ריק ולכן זה נכשל", "الجدول فارغ والفهرس قديم", "먼저 색인을 읽고 다음에 표를 읽는다.", "先读索引，再读表格。", "この表には Nnn 行あります。", "表格为空，索引已过期。",
)
#: Frames and plain sentences for measuring only.
HELD = (
    "Would you forward it to {email}?", "Parcel label: {address}.", "Visitor {name} arrives at noon.", "She gave {phone} as her number.", "This came from {name} on Monday.", "Applicant {name}, residing at {address}, was here.", "Kunde {name} (Tel. {phone}) wartet.", "Zavolejte na {phone}, děkuji.", "Doručit na adresu {address}.",
    "Their passport fails: {id_number}.", "Der Brief ging an {address} zurück.", "Message by {name}: see {email}.", "user {email} and {email} clash", "Ship to {address}", "ring {phone} or write to {email}", "Пишет {name_ru}, {phone}", "Για {name_el}: {email}", "קיבלנו מאת {name_he}.", "رسالة من {name_ar}", "联系人：{name_zh}，{email}", "담당자: {name_ko}", "Meeting with {name} and {name} went well.", "reviewed by {name}", "The form of {name}, {id_number}, is lost.",
)
HELD_PLAIN = (
    "Open Settings, Choose Theme and press Enter.", "Host 10.1.Nn.Nn refused the connection.", "We count Nn nnn rows in Nn tables, Table Nn is empty.", "Version N.n.nn fixes Bug Nnn.", "Transfer to IBAN FRNn Nnnn nnnn nnnn nnnn today.", "Release Notes: New Parser, Faster Index.", "In Chapter Nn, Section N, Nnn Words", "Индекс пуст, Таблица нет.", "Ο Πίνακας είναι άδειος.", "הטבלה ריקה", "索引为空。",
)


def example(r: random.Random, frames: tuple = FRAMES, plain: tuple = PLAIN) -> tuple[str, set[tuple[int, int, str]]]:
    """A text of one to four sentences and where its entities are."""
    text, gold = "", set()
    for _ in range(r.randrange(1, 5)):
        if text:
            text += r.choice((" ", " ", "\n"))
        if r.random() < 0.4:
            text += _filled(r, r.choice(plain))
            continue
        frame = _filled(r, r.choice(frames))
        while frame:
            head, brace, rest = frame.partition("{")
            kind = rest.partition("}")[0]
            if not brace or kind not in MAKE:
                cut = len(head) + len(brace)
                text, frame = text + frame[:cut], frame[cut:]
                continue
            text += head
            value = MAKE[kind](r)
            cue, bar, value = value.rpartition("|")
            text += cue
            gold.add((len(text), len(text) + len(value), kind.split("_")[0] if kind.startswith("name") else kind))
            text += value
            frame = rest.partition("}")[2]
    return text, gold


def examples(n: int, seed: int, frames: tuple = FRAMES, plain: tuple = PLAIN) -> list[tuple[str, set, Names]]:
    r, out = random.Random(seed), []
    for _ in range(n):
        text, gold = example(r, frames, plain)
        words = {fold(w) for a, b, k in gold if k == "name" for w in text[a:b].replace(",", " ").split()}
        given = frozenset(fold(g) for g in GIVENS if r.random() < 0.9) | frozenset(w for w in sorted(words) if r.random() < 0.2)
        out.append((text, gold, Names(given, frozenset(w for w in sorted(words) if w not in map(fold, GIVENS) and r.random() < 0.5))))
    return out


def accuracy(weights: dict[str, float], rows: list[tuple[str, set, Names]], exact: bool = False) -> tuple[float, float]:
    """(precision, recall) over kinds and places, which must overlap or, if `exact`, be equal."""
    hit = told = real = 0
    for text, gold, known in rows:
        found = decode(segments(text, known), weights)
        told, real = told + len(found), real + len(gold)
        hit += sum((s.start, s.end, s.kind) in gold if exact else any(s.kind == k and s.start < b and a < s.end for a, b, k in gold) for s in found)
    return hit / max(1, told), hit / max(1, real)


def train(n: int = ROWS, seed: int = 7) -> dict[str, float]:
    rows = [(segments(t, known), gold) for t, gold, known in examples(n, seed)]
    seen = Counter(f for found, _ in rows for f in {f for s in found for f in s.features})
    for found, _ in rows:
        for s in found:
            s.features = [f for f in s.features if seen[f] >= LEAST]
    return {f: round(w, 3) for f, w in sorted(fit(rows).items()) if abs(w) >= 0.02}


if __name__ == "__main__":
    weights = train()
    print(len(weights), accuracy(weights, examples(1000, 8)), accuracy(weights, examples(1000, 9, HELD, HELD_PLAIN)), accuracy(weights, examples(1000, 9, HELD, HELD_PLAIN), True))
    Path(__file__).with_name("pii_weights.json").write_text(json.dumps(weights, indent=0, ensure_ascii=False) + "\n")
