"""Personal data by format-preserving Feistel pseudonyms, in DataFrame functions only.

Found and replaced: payment cards (13 to 19 digits that pass the Luhn check), IBANs
(that pass mod 97), social security numbers (valid area, group and serial), phone
numbers with a country code, IPv4 addresses (octets up to 255), dates (that exist,
1900 to 2099) and the local part of email addresses. Each value is permuted by a keyed
Feistel network within its format: digits stay digits, letters stay letters of the
same case, separators stay, check digits are made anew, and where the format has holes
the network is walked until it lands on a valid value. So the map is one to one, equal
values get equal pseudonyms in every document, and the key's holder can go back. What
fails its validation is left alone.

Defined results: null stays null, empty texts stay empty; texts are read whole;
repeated rows are changed alike; further columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: a deployment passes its own secret
KEY = "segmenta"
ROUNDS = 8

# Formats of personal data.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
#: digits after the country code, where a country has one length only
PHONE_DIGITS = {8: "45 47", 9: "31 33 34 41 48 61 351 420 421", 10: "1 7 30 44 52 90 91"}
#: characters of an IBAN by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _either(names: str) -> str:
    return f"(?:{names.replace(' ', '|')})"


def _phone(codes: str, n: int) -> str:
    digit = r"(?:[ .-](?=\d\d))?\d"
    area = "|".join(rf"\(\d{{{k}}}\)(?:{digit}){{{n - k}}}" for k in (2, 3, 4))
    return rf"{_either(codes)}[ .-]?(?:{area}|\d(?:{digit}){{{n - 1}}})(?!\d)"


def _iban(lands: str, n: int) -> str:
    whole, rest = divmod(n - 4, 4)
    return rf"{_either(lands)}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{whole}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "") + "(?![A-Za-z0-9])"


# the known lengths first, so that a neighbour is not taken in
PHONE = r"(?<![\w+])\+(?:" + "|".join(_phone(c, n) for n, c in PHONE_DIGITS.items()) + r"|\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d))"
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(_iban(c, n) for n, c in IBAN_LENGTHS.items()) + r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?![\w/-]|\.\d)"
# a run of numbers that holds a card, up to a number that begins another format; see readings
_OTHER = r"\d{3}-\d{2}-\d{4}(?![\w-])|\d{4}-\d{2}-\d{2}(?![\w/-])|\d{1,2}[/.]\d{1,2}[/.]\d{4}(?!\w)|\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
CARD = rf"(?<![\w.])(?=\d(?:[ -]?\d){{12}})\d++(?!\w)(?:(?: (?!{_OTHER})|-)\d++(?!\w))*+"
#: numbers a card is written in, the usual ones first
CARD_SHAPES = (r"\d{13,19}", r"\d{4}([ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{4}[ -]\d{6}[ -]\d{4}", r"\d{6}[ -]\d{13}", r"\d{4}([ -]\d{4}){3}[ -]\d{1,3}")
ANY = "|".join((EMAIL, PHONE, IBAN, SSN, DATE, IPV4, CARD))

_FIRST_DAY, _DAYS = "1900-01-01", 73_049


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _round_hash(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), turn.cast("string"), half), 256)


def _shifted(s: Column, digest: Column) -> Column:
    """Each digit or letter of s moved within its class by the digest's numbers."""

    def one(c: Column, i: Column) -> Column:
        by = _number(F.substring(digest, (i % 16) * 4 + 1, F.lit(4))).cast("int")
        code = F.ascii(c)

        def within(low: int, size: int) -> Column:
            return F.char(F.lit(low) + (code - low + by) % size)

        return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(s, ""), one), "")


def permute_text(v: Column, key: str, kind: str) -> Column:
    """A Feistel permutation of the strings of v's length and classes of characters (ASCII)."""
    cut = F.floor(F.length(v) / 2).cast("int")
    start = F.struct(F.substring(v, F.lit(1), cut).alias("l"), F.substring(v, cut + 1, F.length(v)).alias("r"))
    turns = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(turns, start, lambda a, i: F.struct(a.r.alias("l"), _shifted(a.l, _round_hash(key, kind, i, a.r)).alias("r")), lambda a: F.concat(a.l, a.r))


def permute_number(x: Column, bits_low: int, bits_high: int, key: str, kind: str) -> Column:
    """A Feistel permutation of the numbers below 2 ** (bits_low + bits_high)."""
    low, high = 1 << bits_low, 1 << bits_high
    state = F.struct(F.floor(x / low).cast("long").alias("a"), (x % low).cast("long").alias("b"))
    # both halves change in every turn, each by a number drawn from the other
    turns = F.sequence(F.lit(1), F.lit(ROUNDS // 2))

    def turn(s: Column, i: Column) -> Column:
        a = (s.a + _number(F.substring(_round_hash(key, kind, 2 * i, s.b.cast("string")), 1, 12))) % high
        b = (s.b + _number(F.substring(_round_hash(key, kind, 2 * i + 1, a.cast("string")), 1, 12))) % low
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(turns, state, turn, lambda s: s.a * low + s.b)


def _refilled(v: Column, fresh: Column) -> Column:
    """v with its digits and letters replaced, in order, by the characters of fresh."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def put(a: Column, c: Column) -> Column:
        mine = c.rlike("[A-Za-z0-9]")
        return F.struct(F.concat(a.out, F.when(mine, F.substring(fresh, a.n + 1, F.lit(1))).otherwise(c)).alias("out"), F.when(mine, a.n + 1).otherwise(a.n).alias("n"))

    return F.aggregate(F.split(v, ""), start, put, lambda a: a.out)


def _luhn(digits: Column) -> Column:
    """The Luhn sum, modulo 10, of a string of digits, the last one not doubled."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def _mod97(s: Column) -> Column:
    """An IBAN's characters, its first four moved to the end, modulo 97."""
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _walk(x: Column, step, valid) -> Column:
    """step applied until valid holds; from a valid value that is a permutation of the valid ones."""
    start = F.struct(step(x).alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, lambda a, _: F.when(valid(a.x), a).otherwise(F.struct(step(a.x).alias("x"))), lambda a: a.x)


def _ssn_ok(d: Column) -> Column:
    return ~d.rlike("^(000|666|9)") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def kind_of(v: Column) -> Column:
    """email, phone, iban, ssn, date, ipv4 or card; null if v fails its format's validation."""
    core = F.regexp_replace(v, "[^A-Za-z0-9]", "")
    day = _day(v)
    return (
        F.when(v.contains("@"), "email")
        .when(v.startswith("+"), F.when(F.length(core).between(8, 15), "phone"))
        .when(v.rlike("^[A-Z]"), F.when(F.length(core).between(15, 34) & (_mod97(core) == 1), "iban"))
        .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(_ssn_ok(core), "ssn"))
        .when(v.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), F.when(F.forall(F.split(v, r"\."), lambda o: o.cast("int") <= 255), "ipv4"))
        .when(v.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})$"), F.when(day.between(0, _DAYS - 1), "date"))
        .when(F.length(core).between(13, 19) & ~core.rlike(r"^(\d)\1*$") & (_luhn(core) == 0), "card")
    )


def _is_card(v: Column) -> Column:
    core = F.regexp_replace(v, "[^0-9]", "")
    return F.length(core).between(13, 19) & ~core.rlike(r"^(\d)\1*$") & (_luhn(core) == 0)


def _cards(v: Column) -> Column:
    """A run of numbers cut at the cards in it: the usual shapes wherever they stand, else the longest 13 to 19 digits at the start of what is left."""
    numbers = F.regexp_extract_all(v, F.lit(r"\d+[ -]?"), 0)

    def reading(window: Column, shapes: tuple[str, ...]) -> Column:
        return F.get(F.filter(F.transform(F.array(*(F.regexp_extract(window, rf"^(?:{x})(?!\d)", 0) for x in shapes)), lambda c: F.when((c != "") & _is_card(c), c)), lambda c: c.isNotNull()), F.lit(0))

    usual = F.transform(numbers, lambda _, i: reading(F.array_join(F.slice(numbers, i + 1, 5), ""), CARD_SHAPES))
    both = F.zip_with(numbers, usual, lambda n, u: F.struct(n.alias("number"), u.alias("usual")))
    count = lambda c: F.size(F.split(c, "[ -]"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

    def put(a: Column, x: Column) -> Column:
        tail = lambda n: F.regexp_extract(n, "[ -]$", 0)
        inside = F.struct(F.when(a.skip == 1, F.concat(a.out, F.array(tail(x["number"])))).otherwise(a.out).alias("out"), (a.skip - 1).alias("skip"))
        one = F.struct(F.concat(a.out, F.array(x["usual"], tail(x["number"]))).alias("out"), F.lit(0).alias("skip"))
        more = F.struct(F.concat(a.out, F.array(x["usual"])).alias("out"), (count(x["usual"]) - 1).alias("skip"))
        plain = F.struct(F.concat(a.out, F.array(x["number"])).alias("out"), F.lit(0).alias("skip"))
        return F.when(a.skip > 0, inside).when(x["usual"].isNull(), plain).when(count(x["usual"]) == 1, one).otherwise(more)

    cut = F.aggregate(both, start, put, lambda a: a.out)
    odd = F.regexp_extract(v, r"^\d(?:[ -]?\d){12,18}(?!\d)", 0)
    rest = F.substring(v, F.length(odd) + 1, F.length(v))
    return F.when(F.exists(usual, lambda c: c.isNotNull()), cut).when(_is_card(odd), F.array(odd, rest)).otherwise(F.array(v))


def _ibans(v: Column) -> Column:
    """An IBAN and what follows it, where the whole match is none but its first words are."""
    words = F.split(v, " ")
    lengths = F.create_map(*(F.lit(x) for n, lands in IBAN_LENGTHS.items() for land in lands.split() for x in (land, n)))

    def good(c: Column) -> Column:
        core = F.regexp_replace(c, " ", "")
        return F.length(core).between(15, 34) & (_mod97(core) == 1) & F.coalesce(F.try_element_at(lengths, F.substring(core, 1, 2)) == F.length(core), F.lit(True))

    first = F.get(F.filter(F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, 1, k), " ")), good), F.lit(0))
    return F.when(kind_of(v).isNotNull() | first.isNull(), F.array(v)).otherwise(F.array(first, F.substring(v, F.length(first) + 1, F.length(v))))


def readings(v: Column) -> Column:
    """A match cut into pieces, each a value or not; joined they are the match."""
    single = v.rlike(r"^(?:\d{3}-\d{2}-\d{4}|(?:\d{1,3}\.){3}\d{1,3}|\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})$") | v.contains("@") | v.startswith("+")
    return F.when(single, F.array(v)).when(v.rlike("^[A-Z]"), _ibans(v)).otherwise(_cards(v))


def _parts(v: Column) -> tuple[Column, Column]:
    """(year-month-day as text, whether the month stands first) of a date in any of the formats."""
    p = F.split(v, "[-/.]")
    iso = v.rlike(r"^\d{4}-")
    month_first = ~iso & (F.element_at(p, 2).cast("int") > 12)
    pad = lambda c: F.lpad(c, 2, "0")
    text = F.when(iso, v).otherwise(
        F.concat_ws("-", F.element_at(p, 3), F.when(month_first, pad(F.element_at(p, 1))).otherwise(pad(F.element_at(p, 2))), F.when(month_first, pad(F.element_at(p, 2))).otherwise(pad(F.element_at(p, 1))))
    )
    return text, month_first


def _day(v: Column) -> Column:
    text, _ = _parts(v)
    return F.when(v.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})$"), F.datediff(text.try_cast("date"), F.lit(_FIRST_DAY).cast("date")))


def pseudonym(v: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value; the value itself if it fails its validation."""
    core = F.regexp_replace(v, "[^A-Za-z0-9]", "")
    local, rest = F.substring_index(v, "@", 1), F.substring(v, F.instr(v, "@"), F.length(v))
    email = F.concat(permute_text(local, key, "email"), rest)
    code = F.regexp_extract(v, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    number = F.substring(v, F.length(code) + 1, F.length(v))
    phone = F.concat(code, _refilled(number, permute_text(F.regexp_replace(number, "[^0-9]", ""), key, "phone")))
    body = permute_text(F.substring(core, F.lit(5), F.length(core)), key, "iban")
    land = F.substring(core, 1, 2)
    iban = _refilled(v, F.concat(land, F.lpad((98 - _mod97(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0"), body))
    ssn = _refilled(v, _walk(core, lambda x: permute_text(x, key, "ssn"), _ssn_ok))
    octets = F.transform(F.split(v, r"\."), lambda o: o.cast("long"))
    packed = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    moved = permute_number(packed, 16, 16, key, "ipv4")
    ipv4 = F.array_join(F.transform(F.array(*(F.lit(s) for s in (24, 16, 8, 0))), lambda s: (F.floor(moved / F.pow(F.lit(2.0), s)).cast("long") % 256).cast("string")), ".")
    day = _walk(_day(v).cast("long"), lambda x: permute_number(x, 9, 8, key, "date"), lambda x: x < _DAYS)
    date = F.date_add(F.lit(_FIRST_DAY).cast("date"), day.cast("int"))
    mark = F.when(v.contains("/"), "/").otherwise(".")
    _, month_first = _parts(v)
    # a day first, as in most of the world; where the second number can only be a day the month stands first
    written = F.when(v.rlike(r"^\d{4}-"), F.date_format(date, "yyyy-MM-dd")).otherwise(
        F.concat(F.when(month_first, F.date_format(date, "MM")).otherwise(F.date_format(date, "dd")), mark, F.when(month_first, F.date_format(date, "dd")).otherwise(F.date_format(date, "MM")), mark, F.date_format(date, "yyyy"))
    )
    head = permute_text(F.substring(core, F.lit(1), F.length(core) - 1), key, "card")
    card = _refilled(v, F.concat(head, ((10 - _luhn(F.concat(head, F.lit("0")))) % 10).cast("string")))
    kind = kind_of(v)
    out = F.lit(None).cast("string")
    for name, value in (("email", email), ("phone", phone), ("iban", iban), ("ssn", ssn), ("ipv4", ipv4), ("date", written), ("card", card)):
        out = F.when(kind == name, value).otherwise(out)
    return F.coalesce(out, v)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with text_col rewritten, and the columns pii_kinds and n_pii."""
    text = F.col(text_col)
    # a text without a digit or an @ holds none of the formats
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    d = docs.withColumn("_found", F.transform(found, readings))
    d = d.withColumn("_kinds", F.filter(F.transform(F.flatten("_found"), kind_of), lambda k: k.isNotNull()))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.transform("_found", lambda vs: F.array_join(F.transform(vs, lambda v: pseudonym(v, key)), "")), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return (
        d.withColumn(text_col, F.when(F.size("_kinds") > 0, joined).otherwise(text))
        .withColumn("pii_kinds", F.array_sort(F.array_distinct("_kinds")))
        .withColumn("n_pii", F.greatest(F.size("_kinds"), F.lit(0)).cast("long"))
        .drop("_found", "_kinds")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data, with all columns they came with.

    n_chars, where there is such a column, follows a rewritten text. Every row stays: null
    stays null, texts without any of the formats stay as they are, rows that repeat are
    rewritten alike whatever their id; no documents give no rows.
    """
    made = ("pii_kinds", "n_pii")
    held = {c: f"_of_{c}" for c in made if c in docs.columns}
    out = pseudonymise(docs.withColumnsRenamed(held))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop(*made).withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
