"""Text expressions: tokens, identifier-aware word matching, stems, durations, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..constants import GENERIC_WORDS, SECRET_WORDS, STOPWORDS, UNIT_SECONDS

MASK = "[REDACTED]"
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def split_camel(c: Column) -> Column:
    c = F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.regexp_replace(c, "(?<=[A-Z])(?=[A-Z][a-z])", " ")


def words(c: Column) -> Column:
    """Lower-case ASCII words with camel humps split, empties dropped."""
    return F.filter(F.split(F.lower(split_camel(c)), "[^a-z0-9]+"), lambda w: w != "")


def tokenize(c: Column, min_len: int = 3) -> Column:
    """Task terms in order, repeats kept."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words(c), lambda w: (F.length(w) >= min_len) & ~F.array_contains(stop, w))


def tokenize_task(task: str, min_len: int = 3) -> list[str]:
    """tokenize() of one string on the driver."""
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", task)
    text = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", " ", text).lower()
    return [w for w in re.split("[^a-z0-9]+", text) if len(w) >= min_len and w not in STOPWORDS]


def compounds(task: str) -> dict[str, list[str]]:
    """Raw alphanumeric words that split into two or more terms, lower-cased, with those terms."""
    out = {}
    for raw in re.findall("[A-Za-z0-9]+", task):
        parts = tokenize_task(raw)
        if len(parts) >= 2:
            out[raw.lower()] = parts
    return out


def escape(term: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", term)


def word_pattern(term: str) -> str:
    """Zero-width Java pattern of a term's occurrences with identifier boundaries; overlaps count.

    The term stands free of letters and digits, or starts with a capital after a lower-case letter or
    digit, and then ends before a non-alphanumeric or a capital."""
    t, an = f"(?iu){escape(term)}(?-iu)", r"[\p{L}\p{N}]"
    free = rf"(?<!{an})(?={t}(?!{an}))"
    hump = rf"(?<![\p{{L}}\p{{N}}&&[^\p{{Ll}}\p{{Nd}}]])(?=\p{{Lu}})(?={t}(?:(?!{an})|(?=\p{{Lu}})))"
    return f"(?={t})(?:{free}|{hump})"


def count_word(c: Column, term: str) -> Column:
    return F.regexp_count(c, F.lit(word_pattern(term)))


def has_word(c: Column, term: str) -> Column:
    return c.rlike(word_pattern(term))


def stem(w: Column) -> Column:
    return F.when(F.length(w) >= 6, F.left(w, F.lit(5))).otherwise(w)


def meaningful(ws: Column) -> Column:
    generic = F.array(*[F.lit(w) for w in GENERIC_WORDS])
    return F.array_distinct(F.filter(ws, lambda w: (F.length(w) >= 3) & ~F.array_contains(generic, w)))


def truncate_chars(c: Column, limit: int = 2000) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(F.left(c, F.lit(limit)), "(?U)\\s+$", ""), F.lit(" …[truncated]"))).otherwise(c)


def normalise_key(key: Column) -> Column:
    parts = F.filter(F.split(F.lower(F.trim(key)), "[./]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("-"), F.lit("_"))), ".")


# Unit, substrings and endings of a key that name it, in order of precedence.
UNIT_HINTS = (
    ("ms", ("millisecond",), ("_ms", ".ms")),
    ("minutes", ("minute", "_min"), (".min",)),
    ("seconds", ("second", "_sec"), (".sec",)),
    ("hours", ("hour", "_hr"), (".hr",)),
)


def unit_from_key(key: Column) -> Column:
    k, out = F.lower(key), F.lit(None).cast("string")
    for unit, inside, ends in reversed(UNIT_HINTS):
        hit = F.lit(False)
        for x in inside:
            hit = hit | k.contains(x)
        for x in ends:
            hit = hit | k.endswith(x)
        out = F.when(hit, unit).otherwise(out)
    return out


def line_value(c: Column) -> Column:
    """struct(kind, value): the first duration with a unit in seconds, else the first number; null
    where there is none."""
    units = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    number, unit = F.regexp_extract(c, K.DURATION, 1), F.lower(F.regexp_extract(c, K.DURATION, 2))
    plain = F.regexp_extract(c, K.PLAIN_NUMBER, 1)
    return F.when(number != "", F.struct(F.lit("duration").alias("kind"), (number.cast("double") * F.element_at(units, unit)).alias("value"))).when(plain != "", F.struct(F.lit("number").alias("kind"), plain.cast("double").alias("value")))


def secret_key(key: Column) -> Column:
    k = F.lower(split_camel(key))
    counted = k.rlike(K.COUNTED_TOKENS)
    found = k.contains("token") & ~counted
    for w in SECRET_WORDS:
        found = found | k.contains(w)
    return found


def mask_entropy(c: Column) -> Column:
    """Mask runs of 32 or more token characters that hold a digit, left to right."""
    runs = F.regexp_extract_all(c, F.lit(K.LONG_RUN), F.lit(0))

    def step(acc, x):
        at = F.instr(acc["rest"], x)
        head = F.substring(acc["rest"], F.lit(1), at - 1)
        rest = F.substring(acc["rest"], at + F.length(x), F.length(acc["rest"]))
        return F.struct(F.concat(acc["out"], head, F.when(x.rlike("[0-9]"), MASK).otherwise(x)).alias("out"), rest.alias("rest"))

    return F.aggregate(runs, F.struct(F.lit("").alias("out"), c.alias("rest")), step, lambda a: F.concat(a["out"], a["rest"]))


def redact_line(line: Column, config_format: Column) -> Column:
    """One line with values of secret keys and token-shaped strings masked."""
    key, sep, value = (F.regexp_extract(line, K.SETTING_LINE, i) for i in (1, 2, 3))
    hide = (key != "") & secret_key(F.trim(key)) & ((config_format & (F.trim(value) != "")) | value.rlike(K.STRING_LITERAL))
    out = F.when(hide, F.concat(key, sep, F.lit(MASK))).otherwise(line)
    for p in K.SECRET_SHAPES:
        out = F.regexp_replace(out, p, MASK)
    return mask_entropy(out)


def redact_text(text: Column, config_format: Column) -> Column:
    """Line by line; the body of a PEM block (to its end, or to the end of the text) is masked."""
    begin, end = K.PEM_BEGIN, K.PEM_END

    def step(acc, line):
        inside = acc["pem"]
        ends = line.rlike(end)
        shown = F.when(inside & ~ends, MASK).when(inside | line.rlike(begin), line).otherwise(redact_line(line, config_format))
        return F.struct(F.concat(acc["lines"], F.array(shown)).alias("lines"), F.when(inside, ~ends).otherwise(line.rlike(begin) & ~ends).alias("pem"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(False).alias("pem"))
    return F.aggregate(lines_of(text), start, step, lambda a: F.array_join(a["lines"], "\n"))


def lines_of(text: Column) -> Column:
    """Lines as Python's splitlines gives them."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
