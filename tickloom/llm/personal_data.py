"""Surrogates for personal data, in DataFrame operations alone.

Each kind of entity has one pattern. Its characters are replaced by a keyed permutation of strings of
its own shape: every letter by a letter of the same alphabet and case, every digit by a digit, both
depending on the key and on all other characters; punctuation stays. Telephone numbers are permuted
by their digits alone and addresses of mail in lower case, before they get their form back. So equal entities get equal
surrogates wherever they stand, and different entities of one shape different ones. Addresses of the
Internet are permuted as numbers, so that they stay valid; card numbers keep a valid check digit;
personal names after a title are permuted word by word, the given name with an ending by the title's
gender. No step maps two entities of a kind to one surrogate, so nothing has to be compared or redrawn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import read
from tickloom.llm.decontamination import let

# Patterns of the kinds, in the order in which they are tried.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<=[=\"])(?<=password=|token = \"|secret=|api_key=|token=)[A-Za-z0-9_\-]{12,}|\b[0-9a-f]{32,64}\b|\bAKIA[0-9A-Z]{16}\b",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?=\d)(?<![\d-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=\+)(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?=\()(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?=\d)(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "name": r"(?=\p{Lu})(?<= )(?<=\b(?:Mr|Mrs|Ms|Herr|Frau|Señor|Señora|Madame|Monsieur)\.? )\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
# Alphabets within which characters are exchanged.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
HEX = "0123456789abcdef"
# Alphabets of names; names with other letters are spelt in the letters of their bytes, after a mark that no name has.
NAME_ALPHABETS = (*ALPHABETS[1:], "àáâãäåæèéêëìíîïòóôõöøùúûüýœ", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝŒ", "çñßšžčćłńśźżřťďňğş", "ÇÑŠŽČĆŁŃŚŹŻŘŤĎŇĞŞ")
SPELT = "O'"

COMBINED = "|".join(f"(?:{p})" for p in KINDS.values())
#: Cheaper than the patterns: what every entity has (a digit, an at sign, a title, a long word after "=", a key's mark, letters of a hexadecimal key).
HINT = r"[0-9@=]|AKIA|[a-f]{32}|M(?:r|s|rs|adame|onsieur)\b|Herr|Frau|Señora?"
# Country codes of telephone numbers, of one, two and three digits.
COUNTRY = r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|)(.*)$"


def kind_of(entity: Column) -> Column:
    out = None
    for name, pattern in KINDS.items():
        bare = {"secret": r"[A-Za-z0-9_\-]{12,}", "name": r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?"}.get(name, pattern)
        hit = entity.rlike(f"^(?:{bare})$")
        if name == "secret":  # a card's digits alone are no secret
            hit = hit & entity.rlike("[a-zA-Z]")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("secret")


def _number(*parts: Column) -> Column:
    """A non-negative number from a keyed digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("long")


def permuted(text: Column, key: str, tag: str, alphabets=ALPHABETS) -> Column:
    """A keyed permutation of the strings of one shape.

    Two passes, from either end: each character is shifted within its alphabet by a digest of the
    characters already shifted. A pass can be undone character by character, so none loses anything.
    """

    def shifted(c: Column, by: Column) -> Column:
        out = None
        for a in alphabets:
            at = F.instr(F.lit(a), c)
            new = F.substring(F.lit(a), (at - 1 + by) % len(a) + 1, F.lit(1))
            out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
        return out.otherwise(c)

    def one_pass(t: Column, n: int) -> Column:
        chars = F.filter(F.split(t, ""), lambda c: c != "")
        shape = reduce(lambda x, a: F.translate(x, a[1:], a[0] * (len(a) - 1)), alphabets, t)
        start = F.struct(F.lit("").alias("done"), _number(F.lit(key), F.lit(tag), F.lit(str(n)), shape).alias("state"))
        step = lambda s, c: let(shifted(c, s["state"]), lambda x: F.struct(F.concat(s["done"], x).alias("done"), _number(F.lit(key), s["state"].cast("string"), x).alias("state")))
        return let(F.aggregate(chars, start, step), lambda s: F.reverse(s["done"]))

    return let(let(text, lambda t: one_pass(t, 1)), lambda t: one_pass(t, 2))


def _ip(entity: Column, key: str) -> Column:
    """A Feistel network over the address's two halves; octets written with zeros before them lose those."""
    octets = F.transform(F.split(entity, r"\."), lambda x: x.cast("long"))

    def rounds(v: Column) -> Column:
        halves = F.struct((v[0] * 256 + v[1]).alias("l"), (v[2] * 256 + v[3]).alias("r"))
        step = lambda s, i: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_number(F.lit(key), F.lit("ip"), i.cast("string"), s["r"].cast("string")) % 65536).alias("r"))
        return F.aggregate(F.array(*map(F.lit, range(6))), halves, step)

    return let(let(octets, rounds), lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))


def _check_digit(digits: Column) -> Column:
    """Of the first fifteen digits of a card."""
    values = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return ((10 - F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10) % 10).cast("string")


def _card(entity: Column, key: str) -> Column:
    def then(e: Column) -> Column:
        digits = F.regexp_replace(e, "[ -]", "")
        valid = _check_digit(F.substring(digits, 1, 15)) == F.substring(digits, 16, 1)
        inner = let(permuted(F.substring(digits, 2, 14), key, "card"), lambda p: F.concat(F.substring(digits, 1, 1), p))
        # a number that is no card's stays none
        last = let(inner, lambda i: F.concat(i, F.when(valid, _check_digit(i)).otherwise(((_check_digit(i).cast("int") + 10 + F.substring(digits, 16, 1).cast("int") - _check_digit(F.substring(digits, 1, 15)).cast("int")) % 10).cast("string"))))
        gap = F.regexp_extract(e, "[ -]", 0)
        return let(last, lambda d: F.when(gap == "", d).otherwise(F.concat(F.substring(d, 1, 4), gap, F.substring(d, 5, 4), gap, F.substring(d, 9, 4), gap, F.substring(d, 13, 4))))

    return let(entity, then)


def _name(entity: Column, title: Column, key: str) -> Column:
    """The words of a name, each permuted; a given name (the first of two) ends by the title's gender."""
    spelling = lambda w: F.concat(F.lit(SPELT), F.initcap(F.translate(F.lower(F.hex(F.encode(w, "UTF-8"))), HEX, "abcdefghijklmnop")))
    plain = f"^[{''.join(NAME_ALPHABETS)}]+$"
    new = lambda w, tag: permuted(F.when(w.rlike(plain), w).otherwise(spelling(w)), key, tag, NAME_ALPHABETS)
    # the mark is permuted to itself but for its letter: one apostrophe, which no other name has
    she = title.rlike("^(Mrs|Ms|Frau|Señora|Madame)")
    family, given = F.regexp_extract(entity, r"(\S+)$", 1), F.regexp_extract(entity, r"^(\S+) ", 1)
    by_script = lambda latin, cyrillic, greek: F.when(given.rlike(r"[а-я]$"), cyrillic).when(given.rlike(r"[α-ω]$"), greek).otherwise(latin)
    ending = F.when(she, by_script("a", "а", "α")).otherwise(by_script("o", "о", "ο"))
    return F.when(given == "", new(family, "family")).otherwise(F.concat(new(given, "given"), ending, F.lit(" "), new(family, "family")))


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with other digits in the places of its own."""
    start = F.struct(F.lit("").alias("done"), F.lit(1).alias("at"))
    step = lambda s, c: F.when(c.between("0", "9"), F.struct(F.concat(s["done"], F.substring(digits, s["at"], F.lit(1))).alias("done"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["done"], c).alias("done"), s["at"].alias("at")))
    return F.aggregate(F.split(form, ""), start, step)["done"]


def _phone(entity: Column, key: str) -> Column:
    """The country code stays; the other digits are permuted whatever stands between them."""
    rest = F.regexp_extract(entity, COUNTRY, 2)
    return F.concat(F.regexp_extract(entity, COUNTRY, 1), let(permuted(F.regexp_replace(rest, r"\D", ""), key, "phone"), lambda d: _refilled(rest, d)))


def _email(entity: Column, key: str) -> Column:
    """All before the last domain is permuted in lower case; capitals stay where they were."""
    host = r"^(.*)(\.[A-Za-z]{2,})$"
    own = F.regexp_extract(entity, host, 1)
    new = let(permuted(F.lower(own), key, "email"), lambda p: F.array_join(F.transform(F.split(own, ""), lambda c, i: F.when(c.between("A", "Z"), F.upper(F.substring(p, i + 1, F.lit(1)))).otherwise(F.substring(p, i + 1, F.lit(1)))), ""))
    return F.concat(new, F.regexp_extract(entity, host, 2))


def surrogate(entity: Column, kind: Column, title: Column, key: str) -> Column:
    """The surrogate of an entity."""
    secret = F.when(entity.rlike("^[0-9a-f]+$"), permuted(entity, key, "hex", (HEX,))).otherwise(permuted(entity, key, "secret"))
    return (
        F.when(kind == "email", _email(entity, key)).when(kind == "ip", _ip(entity, key)).when(kind == "card", _card(entity, key)).when(kind == "ssn", permuted(entity, key, "ssn"))
        .when(kind == "phone", _phone(entity, key)).when(kind == "name", _name(entity, title, key)).otherwise(secret)
    )


_TITLE = r"(Mr|Mrs|Ms|Herr|Frau|Señor|Señora|Madame|Monsieur)\.? $"


def _found(text: Column) -> Column:
    """The pieces of a text between entities, and its entities with kind and title."""
    parts, entities = F.split(text, COMBINED, -1), F.regexp_extract_all(text, F.lit(COMBINED), F.lit(0))
    of = lambda e, p: F.struct(e.alias("entity"), kind_of(e).alias("kind"), F.regexp_extract(F.substring(p, -12, 12), _TITLE, 1).alias("title"))
    return let(parts, lambda p: F.struct(p.alias("parts"), F.transform(entities, lambda e, i: of(e, p[i])).alias("entities")))


def replace_personal_data(docs: DataFrame, key: str, counts: bool = True) -> DataFrame:
    """``docs`` with surrogates in ``text`` and, with ``counts``, ``n_entities`` and ``kinds``.

    The same entity gets the same surrogate in every row, whatever stands around it; distinct ones of
    a kind stay distinct. A telephone number is the same however its digits are grouped, an address of
    mail whatever its capitals; both keep their form. Null texts stay null and empty ones empty, with no
    entities; very long texts are taken whole; empty tables stay empty; repeated rows change alike;
    other columns are kept, those named ``n_entities`` or ``kinds`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    some = F.col("text").rlike(HINT)
    parsed = docs.select(*names, F.explode(F.array(F.when(some, _found(F.col("text"))))).alias("found"))
    new = F.transform(F.col("found.entities"), lambda e: surrogate(e["entity"], e["kind"], e["title"], key))
    joined = let(new, lambda s: F.concat_ws("", F.transform(F.col("found.parts"), lambda p, i: F.concat(p, F.coalesce(F.get(s, i), F.lit(""))))))
    out = {c: F.col(c) for c in names} | {"text": F.when(F.size(F.coalesce(F.col("found.entities"), F.array().cast("array<struct<entity:string,kind:string,title:string>>"))) > 0, joined).otherwise(F.col("text"))}
    more = [F.coalesce(F.size("found.entities"), F.lit(0)).alias("n_entities"), F.array_distinct(F.coalesce(F.col("found.entities.kind"), F.array().cast("array<string>"))).alias("kinds")] if counts else []
    return parsed.select(*(c.alias(k) for k, c in out.items()), *more)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogates of this corpus")
