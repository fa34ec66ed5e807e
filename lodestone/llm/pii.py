"""PII surrogates: detected entities get keyed, type-consistent replacements. Native functions only.

Kinds: email, phone, ip, card, iban, national id, secret and name (after a title, or a known given name
before a capitalised word). Every mention of an entity, in whatever format, gets the same replacement,
drawn from its canonical form (letter case and separators removed; for names the words, their script and
the gender of title or given name): digits become digits, letters letters of the same case, separators
stay; phones keep their country code, cards their Luhn validity (or invalidity), emails and hosts their
shape and top-level domain, ips stay valid; names keep their number of words and are drawn for the
gender and in the script of the name's own letters.

All kinds but names are replaced by a keyed permutation of the finite space of their format: two rounds
of a Feistel network over the alternate characters (modular addition of a SHA-512 stream), a step of the
first character, and the rounds backwards. It maps different entities to different replacements and none
to itself, however full the space is. Names are words of syllables.

Collision checks, over all distinct entities of the corpus (pre-aggregated): a replacement that is an
entity of the corpus, or a name's that another name has, is drawn again, until it is free and differs
from every other's. A redrawn name is a syllable longer each time, so its space never fills. The other
kinds are drawn again REDRAWS times at most; in a format so crowded that no free form is found (nearly
all of its forms occur) the first replacement stands, which is some other entity's form, but still
nobody else's replacement. Only redrawn entities are joined back (by broadcast where their checked size
allows); every other replacement is computed in place, so texts are rewritten by a map. Texts are
searched once: the marked texts are written to the shared folder and read for both steps.

Edge cases: null text stays null and empty text empty, both without entities; texts without entities
come back byte for byte; patterns start and end at word edges and take runs possessively, so a text or word of
any length is scanned in linear time; hex runs and names are of any length (a run of over 128 characters
without a digit is no secret), a grouped IBAN equals the same one without spaces; a lower-case particle
ends a name; a name in a script without own syllables gets Latin ones; repeated rows are rewritten alike; rows are told
apart by their place, so null and repeated ids do no harm; an empty table gives no rows. The columns
n_entities, kinds and surrogates replace equally named ones, all others pass as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, fits_broadcast, materialise

KEY = "surrogates-1"
#: Draws after the first of a replacement that occurs in the corpus (all kinds but names).
REDRAWS = 8
#: Characters that mark an entity in a text (not for interchange; a text that has them is searched twice).
OPEN, CLOSE = "\ufdd0", "\ufdd1"

# Titles by gender, given names by gender and script, and syllables of surnames.
TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Sra|Госпожа|госпожа|Κυρία|κυρία",
    "m": "Mr|Herr|Monsieur|Señor|Sr|Господин|господин|Κύριος|κύριος",
    "n": "Dr|Prof",
}
GIVEN = {
    ("f", "latin"): "Ada Bella Clara Diana Elena Flora Greta Helena Irma Julia Karla Laura Maria Nora Paula Rosa",
    ("m", "latin"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul",
    ("n", "latin"): "Alex Andrea Charlie Dominique Eden Jamie Jordan Kim Lou Marian Noa Robin Sascha Sidney Toni Vanja",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Инна Кира Лидия Мария Нина Ольга Полина Раиса Софья Юлия",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Степан",
    ("f", "greek"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Ξένια Όλγα Ρένα Σοφία",
    ("m", "greek"): "Άρης Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης Ιάσων Κώστας Λάμπρος Μάριος Νίκος Παύλος Σπύρος Στέλιος Τάσος Φώτης",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fi ga go ka ke ko la le li lo ma me mo na ne no pa po ra re ri ro sa",
    "cyrillic": "ба бе бо да де до фа фи га го ка ке ко ла ле ли ло ма ме мо на не но па по ра ре ри ро са",
    "greek": "βα βε βο δα δε δο φα φι γα γο κα κε κο λα λε λι λο μα με μο να νε νο πα πο ρα ρε ρι ρο σα",
    "han": "安 白 成 丹 东 芳 方 光 国 海 华 江 金 兰 林 玲 明 宁 平 清 山 石 田 文 武 新 星 雪 阳 永 玉 志",
    "hangul": "가 강 건 경 고 광 규 기 나 남 다 도 동 라 만 명 미 민 배 보 상 서 선 소 수 승 신 아 영 우 은 주",
    "kana": "ア イ ウ エ オ カ キ ク ケ コ サ シ ス セ ソ タ チ テ ト ナ ニ ネ ノ ハ マ ミ ム メ モ ヤ ユ ラ",
    "arabic": "با بو بي تا تو دا دو دي را رو ري سا سو شا عا فا فو قا كا كو لا لو لي ما مو مي نا نو ني ها وا يا",
    "hebrew": "בא בו בי גא גו דא דו דן הא וא זא חן טל יא כא לא לו לי מא מו מי נא נו ני סא פא קא רא רו רי שא תם",
}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "han": r"\p{IsHan}", "hangul": r"\p{IsHangul}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}"}

_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_TITLE = "|".join(TITLES.values())
_KNOWN = "|".join(dict.fromkeys(" ".join(GIVEN.values()).split()))
#: A capitalised word with its parts after hyphens and apostrophes (not a possessive 's).
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]++|-(?=\p{L})|['’](?=\p{Lu}|\p{L}{2}))++"
#: An IBAN in groups of four; the last group has a digit (words in capitals may follow), but for the two
#: countries whose IBANs end in a currency.
_GROUPED = (
    r"MU[0-9]{2}(?: [A-Z0-9]{4}){6} [A-Z]{2}|SC[0-9]{2}(?: [A-Z0-9]{4}){6} [A-Z]{3}"
    r"|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2}(?:(?: [A-Z0-9]{4}){1,5} (?=[A-Z]{0,3}[0-9])[A-Z0-9]{1,4}| (?=[A-Z]{0,3}[0-9])[A-Z0-9]{3,4})"
)
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Each pattern starts with a test of the first character, which is what most places of a text fail.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}+",
    "phone": r"(?=[+(])(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}" + _END + r"|(?<![0-9A-Za-z(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}" + _END + ")",
    "ip": r"(?=[0-9])(?<![0-9A-Za-z.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![0-9A-Za-z]|\.[0-9])",
    "secret": r"(?=[0-9a-fA-F])" + _EDGE + r"(?=[0-9a-fA-F]{32})(?:[0-9a-fA-F]{32,128}+|(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{129,}+)" + _END,
    "card": "(?=[0-9])" + _EDGE + r"(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4})" + _END,
    "iban": "(?=[A-Z])" + _EDGE + r"(?=[A-Z]{2}[0-9]{2})(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|" + _GROUPED + ")" + _END,
    "national": r"(?=[0-9])(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "name": r"(?=[\p{Lu}гκ])(?<![\p{L}\p{N}])(?:(?:" + _TITLE + r")\.? (?:" + _WORD + "(?: " + _WORD + r")*+|\p{Lo}++)|(?:" + _KNOWN + r")(?= \p{Lu})(?: " + _WORD + ")++)",
}
#: The secret comes before the card: a run of 32 digits or more is no card.
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in PATTERNS)
#: For texts without "@".
NO_EMAIL = "|".join(f"(?:{PATTERNS[k]})" for k in PATTERNS if k != "email")


def kind_of(e: Column) -> Column:
    digits = F.length(F.regexp_replace(e, "[^0-9]", ""))
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike("^[+(]"), "phone")
        .when(e.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(e.rlike("^[0-9a-fA-F]{32,}$"), "secret")
        .when(e.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "national")
        .when(e.rlike("^[0-9 -]+$") & (digits >= 13), "card")
        .when(e.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), "iban")
        .otherwise("name")
    )


def _match(e: Column) -> tuple[Column, Column]:
    """(title with its space, the words) of a name's mention."""
    title = F.regexp_extract(e, rf"^((?:{_TITLE})\.? )", 1)
    return title, F.substring(e, F.length(title) + 1, F.length(e))


def canonical_of(kind: Column, e: Column) -> Column:
    """One form for all mentions of an entity. Phones are 'country|digits'; names 'gender script words'."""
    country = F.regexp_extract(e, r"^\+([0-9]{1,3})", 1)
    rest = F.regexp_replace(F.regexp_replace(e, r"^\+[0-9]{1,3}", ""), "[^0-9]", "")
    title, words = _match(e)
    title = F.regexp_replace(title, r"\.? $", "")
    first = F.regexp_extract(words, r"^(\S+) ", 1)
    gender = F.lit("n")
    for g in ("f", "m"):
        known = [x for (sex, _), names in GIVEN.items() if sex == g for x in names.split()]
        gender = F.when(first.isin(known), g).otherwise(gender)
    for g in ("f", "m"):
        gender = F.when(title.isin(TITLES[g].split("|")), g).otherwise(gender)
    script = F.lit("latin")
    for name, pattern in SCRIPTS.items():
        script = F.when(words.rlike(pattern), name).otherwise(script)
    return (
        F.when(kind == "phone", F.concat(country, F.lit("|"), rest))
        .when((kind == "card") | (kind == "national"), F.regexp_replace(e, "[^0-9]", ""))
        .when(kind == "name", F.concat_ws(" ", gender, script, words))
        .when(kind == "iban", F.lower(F.regexp_replace(e, " ", "")))
        .otherwise(F.lower(e))
    )


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _stream(n: Column, *parts) -> Column:
    """At least n bytes in hex, drawn by SHA-512 from the parts."""
    return _let(F.sha2(F.concat_ws("|", *parts), 512), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 64).cast("int")), lambda j: F.sha2(F.concat(h, j.cast("string")), 512)), ""))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _one_of(table: Column, n: Column) -> Column:
    return F.get(table, (n % F.size(table)).cast("int"))


def _tables(of: dict) -> Column:
    """A map of arrays of words."""
    return F.create_map(*[x for k, words in of.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in words.split()]))])


def _chars(text: Column) -> Column:
    """The characters of a text, none for an empty one."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


#: The rounds: the half that moves, and the sign of the stream; half -1 is the step of the first place.
_ROUNDS = [(0, 1), (1, 1), (-1, 1), (1, -1), (0, -1)]


def permute(key: str, kind: Column, attempt: Column, values: Column, sizes: Column) -> Column:
    """A keyed permutation without fixed points of the arrays of numbers below `sizes` (elementwise; the
    first size is at least 2)."""

    def move(now, step):
        other = F.array_join(F.transform(F.filter(now, lambda v, i: i % 2 != step["half"]), lambda v: v.cast("string")), ",")
        stream = _stream(F.size(now), F.lit(key), kind, attempt.cast("string"), step["half"].cast("string"), other)

        def places(drawn):
            shift = lambda i: F.when(step["half"] < 0, F.when(i == 0, _byte(drawn, i) % (F.get(sizes, i) - 1) + 1).otherwise(0)).when(i % 2 == step["half"], _byte(drawn, i)).otherwise(0)
            return F.transform(now, lambda v, i: F.pmod(v + step["sign"] * shift(i), F.get(sizes, i)))

        return F.when(step["half"] < 0, _let(_stream(F.lit(1), F.lit(key), kind, attempt.cast("string"), F.lit("step")), places)).otherwise(_let(stream, places))

    steps = F.array(*[F.struct(F.lit(h).alias("half"), F.lit(s).alias("sign")) for h, s in _ROUNDS])
    return F.aggregate(steps, values, move)


_LOWER, _DIGIT, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def _in_shape(key: str, kind: Column, attempt: Column, text: Column) -> Column:
    """Digits permuted to digits and lower-case letters to letters; the rest stays."""
    signs = F.regexp_replace(text, "[^0-9a-z]", "")
    of = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 97)

    def made(chars):
        sizes = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26))
        drawn = permute(key, kind, attempt, F.transform(chars, of), sizes)
        return _let(drawn, lambda d: _fill(text, F.transform(chars, lambda c, i: F.substring(F.when(c.rlike("[0-9]"), _DIGIT).otherwise(_LOWER), F.get(d, i) + 1, F.lit(1))), "[0-9a-z]"))

    return F.when(F.length(signs) == 0, text).otherwise(_let(_chars(signs), made))


def _fill(text: Column, by: Column, places: str) -> Column:
    """text with its characters that fit `places` replaced, in order, by those of the array `by`."""

    def fill(acc, c):
        fits = c.rlike(places)
        return F.struct(F.concat(acc["out"], F.when(fits, F.coalesce(F.get(by, acc["k"]), c)).otherwise(c)).alias("out"), F.when(fits, acc["k"] + 1).otherwise(acc["k"]).alias("k"))

    return F.aggregate(_chars(text), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), fill, lambda a: a["out"])


def _numbers(key: str, kind: Column, attempt: Column, text: Column) -> Column:
    """A run of hex digits permuted to such a run; of decimal digits to decimal ones."""

    def made(chars):
        size = F.when(text.rlike("^[0-9]+$"), 10).otherwise(16)
        drawn = permute(key, kind, attempt, F.transform(chars, lambda c: F.conv(c, 16, 10).cast("int")), F.transform(chars, lambda c: size))
        return F.array_join(F.transform(drawn, lambda v: F.substring(F.lit(_HEX), v + 1, F.lit(1))), "")

    # longer runs are drawn by hash alone: 129 random digits meet no other run
    drawn = F.substring(_stream(F.length(text), F.lit(key), kind, text, attempt.cast("string")), F.lit(1), F.length(text))
    long = F.when(text.rlike("^[0-9]+$"), F.translate(drawn, "abcdef", "012345")).otherwise(drawn)
    return F.when(F.length(text) > 128, long).otherwise(_let(_chars(text), made))


def _check_digit(body: Column) -> Column:
    """The Luhn digit that completes a body of digits, as a number."""
    n = F.length(body)

    def worth(c, i):
        d = c.cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(_chars(body), worth), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


def _ip(key: str, kind: Column, attempt: Column, canon: Column) -> Column:
    """Valid octets to valid octets; the first stays between 1 and 223, or as it is."""

    def made(parts):
        at = lambda i: F.get(parts, F.lit(i)).cast("int")
        unicast = at(0).between(1, 223)
        values = F.array(at(3), at(1), at(2), F.when(unicast, at(0) - 1).otherwise(0))
        sizes = F.array(F.lit(256), F.lit(256), F.lit(256), F.when(unicast, 223).otherwise(1))
        out = lambda d: F.concat_ws(".", F.when(unicast, F.get(d, F.lit(3)) + 1).otherwise(at(0)), *[F.get(d, F.lit(i)) for i in (1, 2, 0)])
        return _let(permute(key, kind, attempt, values, sizes), out)

    return _let(F.split(canon, r"\."), made)


def _name(key: str, kind: Column, attempt: Column, canon: Column) -> Column:
    """'gender script words': as many words, the last of 4 + attempt syllables (2 + attempt where a
    syllable is a character of its own)."""
    either = lambda script: " ".join(GIVEN.get((g, script), "") for g in "fm").strip() or SYLLABLES[script]
    given = _tables({f"{g} {script}": GIVEN.get((g, script)) or either(script) for script in SYLLABLES for g in "fmn"})
    group, script = F.substring_index(canon, " ", 2), F.get(F.split(canon, " "), F.lit(1))
    words = F.size(F.split(canon, " ")) - 2

    def made(s):
        def draw(table, base):
            return lambda i: _one_of(table, _byte(s, (i + base) % 256) * 256 + _byte(s, (i + base) % 256 + 256))

        count = attempt + F.when(script.isin("han", "hangul", "kana"), 1).otherwise(3)
        last = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), count), draw(F.element_at(_tables(SYLLABLES), script), 0)), ""))
        firsts = F.when(words > 1, F.transform(F.sequence(F.lit(1), words - 1), draw(F.element_at(given, group), 200)))
        return F.concat_ws(" ", group, firsts, last)

    return _let(_stream(F.lit(512), F.lit(key), kind, canon, attempt.cast("string")), made)


def core_of(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The replacement of an entity in canonical form."""
    every = F.length(canon)
    bar = F.instr(canon, "|")
    tail = F.substring(canon, bar + 1, every)
    host_end = every - F.length(F.substring_index(canon, ".", -1)) - 1
    shaped = lambda text: _in_shape(key, kind, attempt, text)
    body = F.substring(canon, F.lit(1), every - 1)
    # the last digit keeps its distance to the check digit, so valid numbers stay valid and others do not become so
    card = _let(shaped(body), lambda b: F.concat(b, F.pmod(F.substring(canon, every, F.lit(1)).cast("int") - _check_digit(body) + _check_digit(b), F.lit(10)).cast("string")))
    return (
        F.when(kind == "email", F.concat(shaped(F.substring(canon, F.lit(1), host_end)), F.substring(canon, host_end + 1, every)))
        .when(kind == "phone", F.concat(F.substring(canon, F.lit(1), bar), shaped(tail)))
        .when(kind == "ip", _ip(key, kind, attempt, canon))
        .when(kind == "secret", _numbers(key, kind, attempt, canon))
        .when(kind == "card", card)
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), shaped(F.substring(canon, F.lit(3), every))))
        .when(kind == "name", _name(key, kind, attempt, canon))
        .otherwise(shaped(canon))
    )


def render(kind: Column, e: Column, core: Column) -> Column:
    """The replacement in the mention's own format."""
    digits = F.regexp_replace(core, "[^0-9]", "")
    # a phone's core starts with its country, which its mention has too, unless it has none
    filled = _fill(e, _chars(digits), "[0-9]")
    cased = F.array_join(F.transform(_chars(core), lambda c, i: F.when(F.substring(e, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    title, _ = _match(e)
    fours = F.trim(F.regexp_replace(F.upper(core), "(.{4})", "$1 "))
    return (
        F.when(kind.isin("phone", "card", "national"), filled)
        .when(kind == "email", cased)
        .when(kind == "iban", F.when(e.contains(" "), fours).otherwise(F.upper(core)))
        .when(kind == "secret", F.when(e == F.upper(e), F.upper(core)).otherwise(core))
        .when(kind == "name", F.concat(title, F.regexp_replace(core, r"^\S+ \S+ ", "")))
        .otherwise(core)
    )


def mark(text: Column) -> Column:
    """The text with OPEN and CLOSE around each entity; as it is where it has one of them."""
    around = f"{OPEN}$0{CLOSE}"
    found = F.when(text.contains("@"), F.regexp_replace(text, ANY, around)).otherwise(F.regexp_replace(text, NO_EMAIL, around))
    return F.when(_odd(text), text).otherwise(found)


def _odd(text: Column) -> Column:
    return text.contains(OPEN) | text.contains(CLOSE)


def _parts(marked: Column, odd: Column) -> tuple[Column, Column]:
    """(pieces between the entities, mentions) of a marked text."""
    parts = F.split(F.coalesce(marked, F.lit("")), f"[{OPEN}{CLOSE}]", -1)
    pick = lambda k: F.filter(parts, lambda _, i: i % 2 == k)
    return (
        F.when(odd, F.split(marked, ANY, -1)).otherwise(pick(0)),
        F.when(odd, F.regexp_extract_all(marked, F.lit(ANY), F.lit(0))).otherwise(pick(1)),
    )


def _typed(mentions: Column) -> Column:
    """array<struct<kind, canon, mention>>"""
    typed = F.transform(mentions, lambda e: F.struct(kind_of(e).alias("kind"), e.alias("mention")))
    return F.transform(typed, lambda x: F.struct(x["kind"].alias("kind"), canonical_of(x["kind"], x["mention"]).alias("canon"), x["mention"].alias("mention")))


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entities(kind, canon), distinct -> (kind, canon, attempt) of those not on their first attempt."""
    spark = entities.sparkSession
    entities = entities.select("kind", "canon")
    core = core_of(key, F.col("kind"), F.col("canon"), F.col("attempt"))
    first, path = materialise(entities.withColumn("attempt", F.lit(0)).withColumn("core", core), "drawn")
    # no redrawn replacement may be an entity, nor anyone's first replacement
    barred, barred_path = materialise(entities.select("kind", F.col("canon").alias("core")).union(first.select("kind", "core")).distinct(), "barred")
    occurs = entities.select("kind", F.col("canon").alias("core"), F.lit(True).alias("occurs"))
    owners = first.groupBy("kind", "core").agg(F.min("canon").alias("owner")).join(occurs, ["kind", "core"], "left")
    lost, lost_path = materialise(first.join(owners, ["kind", "core"]).filter("occurs or canon <> owner").select("kind", "canon"), "lost")
    used, paths, attempt, chosen = barred, [path, barred_path, lost_path], 0, None
    while True:
        attempt += 1
        waiting = lost if attempt <= REDRAWS else lost.filter("kind = 'name'")
        if waiting.isEmpty():
            break
        drawn, path = materialise(waiting.withColumn("attempt", F.lit(attempt)).withColumn("core", core).join(used, ["kind", "core"], "left_anti"), "drawn")
        won = drawn.groupBy("kind", "core").agg(F.min("canon").alias("canon"), F.lit(attempt).alias("attempt"))
        won, won_path = materialise(won, "won")
        lost, lost_path = materialise(waiting.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "lost")
        used = used.union(won.select("kind", "core"))
        chosen = won if chosen is None else chosen.union(won)
        paths += [path, won_path, lost_path]
    if chosen is None:
        out = entities.limit(0).withColumn("attempt", F.lit(0))
    else:
        out = chosen.select("kind", "canon", "attempt")
    out, _ = materialise(out, "redrawn")
    for p in paths:
        discard(spark, p)
    return out


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with text rewritten, and n_entities, kinds and surrogates (in the order of the text)."""
    names = [c for c in docs.columns if c not in ("text", "n_entities", "kinds", "surrogates")]
    kept = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), mark(text).alias("marked"), F.coalesce(_odd(text), F.lit(False)).alias("odd"))
    rows, _ = materialise(rows, "marked")
    pieces, mentions = _parts(F.col("marked"), F.col("odd"))
    some = F.col("odd") | F.col("marked").contains(OPEN)
    found = rows.filter(some).select("row", F.explode(_typed(mentions)).alias("e")).select("row", "e.kind", "e.canon")
    entities, path = materialise(found.groupBy("kind", "canon").agg(F.count("*").alias("n")), "entities")
    redrawn = assign(entities, key)
    n = redrawn.count()
    typed = F.when(some, _typed(mentions)).otherwise(F.array().cast("array<struct<kind: string, canon: string, mention: string>>"))
    rows = rows.withColumn("found", typed)
    attempt = lambda x: F.lit(0)
    if n:
        # per row with redrawn entities, their attempts
        hits = found.distinct().join(F.broadcast(redrawn) if fits_broadcast(n, 120) else redrawn.hint("merge"), ["kind", "canon"])
        hits = hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("tries"))
        hits, _ = materialise(hits, "hits")
        m = hits.count()
        rows = rows.join(F.broadcast(hits) if fits_broadcast(m, 200) else hits.hint("merge"), "row", "left")
        attempt = lambda x: F.coalesce(F.element_at(F.col("tries"), F.concat_ws("|", x["kind"], x["canon"])), F.lit(0))
    discard(docs.sparkSession, path)
    made = F.transform("found", lambda x: _let(core_of(key, x["kind"], x["canon"], attempt(x)), lambda core: render(x["kind"], x["mention"], core)))
    rows = rows.withColumn("made", made)
    woven = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("made", i), F.lit("")))), "")
    facts = F.struct(
        F.when(F.size("found") > 0, woven).otherwise(F.col("marked")).alias("text"),
        F.size("found").alias("n_entities"),
        F.transform("found", lambda x: x["kind"]).alias("kinds"),
        F.col("made").alias("surrogates"),
    )
    # in two steps, so that no foreign name meets an own one
    return rows.select("kept", facts.alias("facts")).select(*[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names)], "facts.*")


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(documents(spark, sf_dir).select("doc_id", "text"))
