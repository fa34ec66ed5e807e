import random
import re

import regex
from pyspark.sql import functions as F

from lodestone.llm import pii

from .cases import empty, frame

TEXTS = [
    "Write to Ann.Lee+x@mail4.example.com, ann.lee+X@MAIL4.example.com. Call +1 (132) 555-1352 or +1 132-555-1352 today.",
    "From 129.45.227.94&&& and 38.101.105.188, card 4111111111111111 or 4111 1111 1111 1111, not 4111111111111112.",
    'token = "a5a6b8714a59bfca3cab47224b862a3bee98dc2b"### IBAN DE89370400440532013000, id 123-45-6789.',
    "Dear Mrs. Jane Miller and Mr Miller, Frau Özil; Господин Иванов met Κυρία Παπά. Dr Who Knows.",
    "Nothing private here: 12:30, 2024-01-02, 3.14, v1.2.3.4.5, a@b, x1234567890123456, Mr. who.",
    "Again Mrs Jane Miller from ann.lee+x@mail4.example.com",
]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_replacements(spark):
    got = rows(pii.replace_entities(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")))
    a, b = got[0]["surrogates"][:2]
    assert a.lower() == b.lower() and a != "Ann.Lee+x@mail4.example.com" and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\+[a-z]@[a-z]{4}\d\.[a-z]{7}\.com", a)
    p, q = got[0]["surrogates"][2:]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", p) and re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "11325551352"
    assert got[1]["kinds"] == ["ip", "ip", "card", "card", "card"]
    ips = got[1]["surrogates"][:2]
    assert all(0 <= int(x) <= 255 for ip in ips for x in ip.split(".")) and ips[0] != ips[1]
    luhn = lambda d: sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    c1, c2, c3 = got[1]["surrogates"][2:]
    assert c2.replace(" ", "") == c1 and luhn(c1) and len(c1) == 16 and c3 != c1
    assert got[2]["kinds"] == ["secret", "iban", "national"]
    assert re.fullmatch("[0-9a-f]{40}", got[2]["surrogates"][0]) and got[2]["surrogates"][1].startswith("DE")
    upper = rows(pii.replace_entities(spark.createDataFrame([(0, TEXTS[2].upper()), (1, TEXTS[2])], "doc_id long, text string")))
    assert upper[0]["kinds"][0] == "secret" and upper[0]["surrogates"][0] == upper[1]["surrogates"][0].upper()
    names = got[3]["surrogates"]
    assert got[3]["kinds"] == ["name"] * 6
    assert names[0].split()[1] in pii.GIVEN["f", "latin"].split() and names[1].startswith("Mr ") and len(names[1].split()) == 2
    assert regex.fullmatch(r"Господин \p{Cyrillic}+", names[3]) and regex.fullmatch(r"Κυρία \p{Greek}+", names[4])
    assert got[4]["text"] == TEXTS[4] and got[4]["n_entities"] == 0
    assert got[5]["surrogates"][0].split()[1:] == names[0].split()[1:] and got[5]["surrogates"][1] == a.lower()
    for i, t in enumerate(TEXTS):  # everything between the entities is untouched
        left, rest = got[i]["text"], t
        for m, s in zip(regex.finditer(pii.ANY, t), got[i]["surrogates"], strict=True):
            assert m.group(0) not in got[i]["text"]
        assert regex.sub(pii.ANY, "\0", rest) == re.sub("|".join(map(re.escape, got[i]["surrogates"])) or "$^", "\0", left)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, before = rows(pii.op9_surrogates(spark, "/root/testdata/sf0.01")), rows(docs)
    assert len(got) == len(before)
    pairs, found = {}, regex.compile(pii.ANY)
    for i, r in got.items():
        mentions = [m.group(0) for m in found.finditer(before[i]["text"] or "")]
        assert len(mentions) == r["n_entities"]
        if not mentions:
            assert r["text"] == before[i]["text"]
        for m, s in zip(mentions, r["surrogates"], strict=True):
            assert pairs.setdefault(m, s) == s != m
            assert regex.sub("[0-9]", "0", regex.sub("[a-z]", "a", m)) == regex.sub("[0-9]", "0", regex.sub("[a-z]", "a", s)) or "." in m or len(m) == 40
    assert len(set(pairs.values())) == len(pairs) > 50
    assert not set(pairs) & set(pairs.values())


def test_collisions_are_drawn_again(spark):
    """Ids of two digits: 25 entities occur, so their replacements are 25 of the other 75."""
    rows_ = [("national", f"{i:02d}") for i in range(0, 25)]
    got = cores(spark, rows_)
    assert len(set(got.values())) == 25 and not set(got.values()) & {c for _, c in rows_}


def cores(spark, entities):
    df = spark.createDataFrame(entities, "kind string, canon string")
    extra = {(r["kind"], r["canon"]): r["attempt"] for r in pii.assign(df).collect()}
    tried = spark.createDataFrame([(k, c, extra.get((k, c), 0)) for k, c in entities], "kind string, canon string, attempt int")
    return {(r[0], r[1]): r[2] for r in tried.select("kind", "canon", pii.core_of(pii.KEY, F.col("kind"), F.col("canon"), F.col("attempt"))).collect()}


def test_full_spaces_of_a_format(spark):
    """All 676 emails of one shape, 9,000 of 10,000 phones, all 100 ids: every replacement is another
    one of the shape, no two are equal and none is the entity itself."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    entities = [("email", f"{a}@{b}.co") for a in letters for b in letters]
    entities += [("phone", f"49|{i:04d}") for i in range(9000)] + [("national", f"{i:02d}") for i in range(100)]
    got = cores(spark, entities)
    for kind, shape in (("email", r"[a-z]@[a-z]\.co"), ("phone", r"49\|\d{4}"), ("national", r"\d\d")):
        of = {c: s for (k, c), s in got.items() if k == kind}
        assert len(set(of.values())) == len(of) and all(c != s and re.fullmatch(shape, s) for c, s in of.items())


def test_many_names_differ(spark):
    entities = [("name", f"m latin Given{i} Sur{i}") for i in range(3000)] + [("name", f"f cyrillic Имя{i}") for i in range(2000)] + [("name", f"n han 王{i}") for i in range(1500)]
    got = cores(spark, entities)
    assert len(set(got.values())) == len(entities)
    for (_, c), s in got.items():
        assert s.split()[:2] == c.split()[:2] and len(s.split()) == len(c.split()) and s != c


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def planted(rng):
    """(kind, entity, mention) of every kind, made without the module's patterns."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    kind = rng.choice(["email", "phone", "ip", "card", "iban", "national", "secret", "name"])
    if kind == "email":
        e = f"{word(5)}.{word(3)}{digits(2)}@{word(6)}.com"
        return kind, e, rng.choice([e, e.upper()])
    if kind == "phone":
        d = digits(7)
        return kind, d, rng.choice([f"+49 {d[:3]} {d[3:]}", f"+49-{d[:3]}-{d[3:]}"])
    if kind == "ip":
        e = ".".join(str(rng.randrange(1, 224)) for _ in range(4))
        return kind, e, e
    if kind == "card":
        body = digits(15)
        e = next(body + str(k) for k in range(10) if luhn(body + str(k)))
        return kind, e, rng.choice([e, f"{e[:4]} {e[4:8]} {e[8:12]} {e[12:]}"])
    if kind == "iban":
        e = f"DE{digits(20)}"
        return kind, e, rng.choice([e, " ".join(e[i : i + 4] for i in range(0, 22, 4))])
    if kind == "national":
        e = f"{digits(3)}-{digits(2)}-{digits(4)}"
        return kind, e, e
    if kind == "secret":
        e = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        return kind, e, rng.choice([e, e.upper()])
    sur, (title, given) = word(6).capitalize(), rng.choice([("Mrs", "Clara"), ("Mr", "Hugo"), ("Mr.", "Paul")])
    return kind, f"{given} {sur}", rng.choice([f"{title} {given} {sur}", f"{given} {sur}"])


def test_planted_entities(spark):
    """Brute force: texts are built from known pieces, so the result is known up to the replacements."""
    rng = random.Random(8)
    pool = [planted(rng) for _ in range(120)]
    texts = [[(f"wort {i} und,", *rng.choice(pool)) for _ in range(rng.randrange(4))] for i in range(300)]
    df = spark.createDataFrame([(i, " ".join(f"{w} {m}," for w, _, _, m in t) + " ende.") for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got, of = rows(pii.replace_entities(df)), {}
    for i, t in enumerate(texts):
        assert got[i]["kinds"] == [k for _, k, _, _ in t]
        assert got[i]["text"] == " ".join(f"{w} {s}," for (w, *_), s in zip(t, got[i]["surrogates"], strict=True)) + " ende."
        for (_, kind, entity, mention), s in zip(t, got[i]["surrogates"]):
            if kind == "name":
                plain = s.removeprefix("Mrs ").removeprefix("Mr ").removeprefix("Mr. ")
                assert len(s) - len(plain) == len(mention) - len(entity) and len(plain.split()) == 2
            else:
                plain = re.sub("[^0-9a-z]", "", s.lower())
                assert re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", s))) == re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", mention))) or kind in ("ip", "secret")
            assert kind != "card" or luhn(plain)
            assert kind != "ip" or all(0 <= int(x) <= 255 for x in s.split("."))
            assert of.setdefault((kind, entity), plain) == plain
    assert len(of) > 100 and len(set(of.values())) == len(of)
    assert not {v for v in of.values()} & {re.sub("[^0-9a-z]", "", e.lower()) if k != "name" else e for k, e in of}


def test_scripts_and_names_without_title(spark):
    texts = ["Mr Иванов and Dr Παπάς met Иван Петров, Mrs 李 and Mr 김민수.", "Later Mr Иван Петров and Clara Weiss left; Clara alone stayed, Rosa did too."]
    got = rows(pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    a, b = got[0]["surrogates"], got[1]["surrogates"]
    assert regex.fullmatch(r"Mr \p{Cyrillic}+", a[0]) and regex.fullmatch(r"Dr \p{Greek}+", a[1]) and regex.fullmatch(r"\p{Cyrillic}+ \p{Cyrillic}+", a[2])
    assert regex.fullmatch(r"Mrs \p{Han}+", a[3]) and regex.fullmatch(r"Mr \p{Hangul}+", a[4])
    assert b[0] == "Mr " + a[2] and a[2].split()[0] in pii.GIVEN["m", "cyrillic"].split()
    assert b[1].split()[0] in pii.GIVEN["f", "latin"].split() and len(b) == 2 and "Clara alone stayed, Rosa did" in got[1]["text"]


def test_texts_with_the_marks_and_clashing_columns(spark):
    text = f"odd {pii.OPEN}x{pii.CLOSE} at 1.2.3.4 and a.b@c.de"
    df = spark.createDataFrame([(1, text, "r", "k"), (1, "1.2.3.4", "s", None), (None, "1.2.3.4", None, None), (None, None, "", "")], "doc_id long, text string, found string, tries string")
    df = df.withColumn("marked", F.lit("m")).withColumn("made", F.lit(1)).withColumn("row", F.lit("own"))
    got = pii.replace_entities(df).collect()
    assert [(r["found"], r["tries"], r["marked"], r["made"], r["row"]) for r in sorted(got, key=lambda r: str(r["found"]))] == [(f, t, "m", 1, "own") for f, t in [("", ""), (None, None), ("r", "k"), ("s", None)]]
    odd = next(r for r in got if r["found"] == "r")
    assert odd["kinds"] == ["ip", "email"] and odd["text"] == text.replace("1.2.3.4", odd["surrogates"][0]).replace("a.b@c.de", odd["surrogates"][1])
    assert next(r for r in got if r["found"] == "s")["text"] == odd["surrogates"][0]


def test_exceptions_reach_the_texts(spark, monkeypatch):
    real = pii.assign

    def forced(entities, key=pii.KEY):
        return entities.filter("kind = 'ip'").withColumn("attempt", F.lit(3))

    df = spark.createDataFrame([(1, "at 1.2.3.4 and 1.2.3.4"), (None, "1.2.3.4"), (2, "a@b.cd")], "doc_id long, text string")
    base = rows(pii.replace_entities(df))
    monkeypatch.setattr(pii, "assign", forced)
    got = rows(pii.replace_entities(df))
    assert got[1]["surrogates"][0] == got[1]["surrogates"][1] == got[None]["surrogates"][0] != base[1]["surrogates"][0]
    assert got[2]["text"] == base[2]["text"] and real is not forced


def test_edges(spark):
    got = pii.replace_entities(frame(spark))
    want = sorted(((r["doc_id"], r["text"]) for r in frame(spark).collect()), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == want
    assert set(frame(spark).columns) <= set(got.columns)
    assert pii.replace_entities(empty(spark)).count() == 0
    long = frame(spark, [(1, "a" * 200_000 + " " + "1" * 200_000 + " x@y.zw")])
    assert pii.replace_entities(long).first()["n_entities"] in (1, 2)


def test_long_and_grouped_entities_leave_nothing(spark):
    key = "".join(random.Random(4).choice("0123456789abcdef") for _ in range(4096))
    cases = [
        (f"key {key}.", ["secret"], [key[:129], key[-40:]]),
        (f"key {key[:129].upper()} and {key[:129]}", ["secret", "secret"], [key[:129]]),
        ("Mr Juan Carlos Garcia met Mrs Anna Schmidt-Weber.", ["name", "name"], ["Juan", "Carlos", "Garcia", "Anna", "Schmidt", "Weber"]),
        ("Mr O'Neil and Dr. D’Angelo saw Mr Miller's car", ["name", "name", "name"], ["Neil", "Angelo", "Miller"]),
        ("to DE89 3704 0044 0532 0130 00 EUR 5 or DE89370400440532013000", ["iban", "iban"], ["DE89", "3704 0044", "37040044"]),
        ("AT61 1904 3002 3457 3201 FROM BANK, NO93 8601 1117 947, MT84 MALT 0110 0001 2345 MTLC AST0 01S", ["iban"] * 3, ["1904 3002", "3457 3201", "8601 1117 947", "MALT", "MTLC", "AST0"]),
        ("MU17 BOMM 0101 1010 3030 0200 000M UR", ["iban"], ["BOMM", "000M UR"]),
        ("M" + "r " + "A" + "b" * 60, ["name"], ["bb"]),
    ]
    got = rows(pii.replace_entities(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")))
    for i, (text, kinds, gone) in enumerate(cases):
        assert got[i]["kinds"] == kinds, text
        assert not [g for g in gone if g.lower() in got[i]["text"].lower()], (text, got[i]["text"])
    s = got[0]["surrogates"][0]
    assert len(s) == 4096 and re.fullmatch("[0-9a-f]+", s)
    a, b = got[1]["surrogates"]
    assert a == b.upper()
    a, b = got[4]["surrogates"]
    assert a.replace(" ", "") == b and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", a) and "EUR 5 or" in got[4]["text"]
    assert "FROM BANK" in got[5]["text"] and "'s car" in got[3]["text"]
