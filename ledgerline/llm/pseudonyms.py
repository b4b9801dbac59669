"""Format-preserving Feistel pseudonyms for validated numbers, dates and addresses.

Every value is permuted by a keyed Feistel network inside the set of values of its own
format, so that a card number stays a valid card number and a date a date, and equal
values get equal pseudonyms in all documents, whatever their separators. Different
values get different ones. The network f is used as f^-1(f(x) + 1), which no value
survives unchanged. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import require

#: Stands before a separated card number with a right check digit while values are searched; AS_IS follows a text's own.
MARK, AS_IS = "\ue000", "\ue001"
EMAIL = rf"[A-Za-z0-9._%+{MARK}-]*[A-Za-z0-9][A-Za-z0-9._%+{MARK}-]*@[A-Za-z0-9{MARK}-]+(?:\.[A-Za-z0-9{MARK}-]+)*\.[A-Za-z]{{2,}}"
IPV4 = r"(?<![0-9A-Za-z.])(?:\d{1,3}\.){3}\d{1,3}(?![0-9A-Za-z]|\.\d)"
DATE = (r"(?<![0-9A-Za-z/-])(?:\d{4}-\d{2}-\d{2}(?![0-9A-SU-Za-su-z/-]|[Tt](?!\d\d))|\d{1,2}/\d{1,2}/\d{4}(?![0-9A-Za-z/-])"
        r"|(?<!\d\.)\d{1,2}\.\d{1,2}\.\d{4}(?![0-9A-Za-z/-]|\.\d))")
SSN = r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])"
#: 8 to 15 digits with little between them, written out because a look behind takes no repeated group.
_TO_15 = r"[ .()-]{0,3}\d" * 8 + r"(?:[ .()-]{0,3}\d)?" * 7
#: With a country code, at most as many groups as give 15 digits, and not on into a date; then an area in brackets; then forms of ten digits; then a leading 0.
PHONE = (r"(?<![0-9A-Za-z+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}"
         r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?(?!\d{4}-\d{2}-\d{2}(?!\d))\d{2,4}){1,4}(?<=\+" + _TO_15 + ")"
         r"|\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?(?!\d{4}-\d{2}-\d{2}(?!\d))\d{2,4}){1,2}(?<=\(" + _TO_15 + ")"
         r"|(?<!\d[.-])(?:1[ .-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3}[ -]\d{4})(?![.-]\d)"
         r"|(?<!\d[./-])0[1-9](?:\d{1,3}[ /-](?:\d{6,8}|\d{3,4}[ -]\d{3,5})|(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})(?![./-]\d))(?![0-9A-Za-z])")
SPACED_CARD = r"(?<![0-9A-Za-z])(?:\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![0-9A-Za-z])"
PLAIN_CARD = r"(?<![0-9A-Za-z])\d{13,19}(?![0-9A-Za-z])"
CARD = f"{SPACED_CARD}|{PLAIN_CARD}"
MARKED_CARD = (rf"{MARK}(?:\d{{4}} {MARK}?\d{{4}} {MARK}?\d{{4}} {MARK}?\d{{1,7}}|\d{{4}}-{MARK}?\d{{4}}-{MARK}?\d{{4}}-{MARK}?\d{{1,7}}"
               rf"|\d{{4}} \d{{6}} \d{{5}}|\d{{4}}-\d{{6}}-\d{{5}})(?![0-9A-Za-z])|{PLAIN_CARD}")
KINDS = {"email": EMAIL, "ipv4": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
#: What can hold a value, and the search in a text with marks. All but an address begin with one of a few characters.
HOLDS, ANY = (f"(?:{EMAIL})|(?=[0-9(+{MARK}])(?:{'|'.join(f'(?:{p})' for p in (IPV4, DATE, SSN, PHONE, card))})" for card in (CARD, MARKED_CARD))

# The country codes of one and two digits; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

ROUNDS = 8
#: Dates that count: 1900-01-01 to 2099-12-31, 73,049 days = 17 x 4297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
#: Social security numbers that are never issued begin with these.
NO_AREA = r"^(?:000|666|9)|^...-?00|0000$"
#: Steps of cycle walking to an issued number; about one step in ten is not one.
WALK = 40


def _prf(key: str, tweak: Column, turn: Column, other: Column) -> Column:
    """64 hex digits from the key, the kind, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), other), 256)


def _turns(start: Column, change) -> Column:
    """f, then one step, then f backward; ``change(state, round, sign)`` or a step for sign 0."""
    def turn(state: Column, i: Column) -> Column:
        back = i > ROUNDS
        at = F.when(back, 2 * ROUNDS - i).otherwise(i)
        return change(state, at, F.when(i == ROUNDS, 0).when(back, -1).otherwise(1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), start, turn)


def permute_pair(left: Column, right: Column, a: int, b: int, tweak: Column, key: str) -> Column:
    """A pair in Z_a x Z_b, as struct(l, r) of longs."""
    def change(s: Column, at: Column, sign: Column) -> Column:
        even = at % 2 == 0
        mask = F.conv(F.substring(_prf(key, tweak, at, F.when(even, s["r"]).otherwise(s["l"]).cast("string")), 1, 12), 16, 10).cast("long")
        left_ = F.when((sign != 0) & even, F.pmod(s["l"] + sign * (mask % a), F.lit(a))).otherwise(s["l"])
        right_ = F.when(sign == 0, F.pmod(s["r"] + 1, F.lit(b))).when(~even, F.pmod(s["r"] + sign * (mask % b), F.lit(b))).otherwise(s["r"])
        return F.struct(left_.cast("long").alias("l"), right_.cast("long").alias("r"))
    return _turns(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), change)


def _letters(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def _base(c: Column) -> Column:
    """First code of a character's class: digits, small or capital letters."""
    return F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).otherwise(65)


def permute_letters(s: Column, tweak: Column, key: str) -> Column:
    """A string of ASCII letters and digits to one with the same class at every place."""
    places = F.transform(_letters(s), lambda c: F.struct((F.ascii(c) - _base(c)).alias("v"), F.when(_base(c) == 48, 10).otherwise(26).alias("m"), _base(c).alias("b")))
    half = F.floor(F.length(s) / 2).cast("int")

    def shifted(part: Column, other: Column, at: Column, sign: Column) -> Column:
        hexes = _prf(key, tweak, at, F.array_join(F.transform(other, lambda p: p["v"].cast("string")), ","))
        mask = lambda i: F.conv(F.substring(hexes, (i % 15) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.transform(part, lambda p, i: F.struct(F.pmod(p["v"] + sign * mask(i), p["m"]).cast("int").alias("v"), p["m"].alias("m"), p["b"].alias("b")))

    def change(s: Column, at: Column, sign: Column) -> Column:
        even = at % 2 == 0
        step = F.transform(s["r"], lambda p, i: F.struct(F.when(i == 0, F.pmod(p["v"] + 1, p["m"])).otherwise(p["v"]).cast("int").alias("v"), p["m"].alias("m"), p["b"].alias("b")))
        left = F.when((sign != 0) & even, shifted(s["l"], s["r"], at, sign)).otherwise(s["l"])
        right = F.when(sign == 0, step).when(~even, shifted(s["r"], s["l"], at, sign)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    kind = "array<struct<v:int,m:int,b:int>>"
    start = F.struct(F.slice(places, F.lit(1), half).cast(kind).alias("l"), F.slice(places, half + 1, F.length(s) - half).cast(kind).alias("r"))
    done = _turns(start, change)
    return F.array_join(F.transform(F.concat(done["l"], done["r"]), lambda p: F.char(p["v"] + p["b"])), "")


def refill(form: Column, values: Column, pattern: str = "[0-9]") -> Column:
    """The form with its characters of a class replaced, in order, by those of a string."""
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))

    def add(acc: Column, c: Column) -> Column:
        fits = F.regexp_like(c, F.lit(f"^{pattern}$"))
        return F.struct((acc["k"] + fits.cast("int")).alias("k"), F.concat(acc["out"], F.when(fits, F.substring(values, acc["k"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(_letters(form), start, add, lambda acc: acc["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled; 0 modulo 10 in a valid number."""
    one = lambda c, i: F.when(i % 2 == 1, F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.reverse(_letters(digits)), one), F.lit(0), lambda a, b: a + b)


def _octet(m: Column, i: int) -> Column:
    return F.split(m, r"\.")[i].cast("int")


def _canonical_ip(m: Column) -> Column:
    return F.regexp_like(m, F.lit(r"^(?:(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])(?:\.|$)){4}(?<!\.)$"))


def _date_parts(m: Column) -> tuple[Column, Column, Column]:
    """The parts of a date with slashes or dots, if the day stands first in it, and if it is none of these but in ISO form.

    With slashes the month is first if both orders fit, with dots the day.
    """
    part = F.split(m, "[/.]")
    a, b = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    return part, F.when(m.contains("/"), a.cast("int") > 12).otherwise(b.cast("int") <= 12), m.contains("-")


def _date_of(m: Column) -> Column:
    """The date, or null."""
    part, day_first, iso = _date_parts(m)
    a, b = (F.lpad(F.get(part, F.lit(i)), 2, "0") for i in (0, 1))
    written = F.concat_ws("-", F.get(part, F.lit(2)), F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b))
    return F.try_to_date(F.when(iso, m).otherwise(written), "yyyy-MM-dd")


def _date_like(m: Column, date: Column) -> Column:
    """A date in the writing of another: its order, its separator, and zeros in front where it shows them or can have none."""
    part, day_first, iso = _date_parts(m)
    a, b = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    shown = lambda x, own, other: F.when((F.length(own) == 2) & (own.startswith("0") | (F.length(other) == 2)), F.lpad(x, 2, "0")).otherwise(x)
    day, month = F.dayofmonth(date).cast("string"), F.month(date).cast("string")
    sep = F.when(m.contains("/"), "/").otherwise(".")
    first, second = F.when(day_first, day).otherwise(month), F.when(day_first, month).otherwise(day)
    return F.when(iso, F.date_format(date, "yyyy-MM-dd")).otherwise(
        F.concat(shown(first, a, b), sep, shown(second, b, a), sep, F.year(date).cast("string")))


def _checks(digits: Column) -> Column:
    return (luhn_sum(digits) % 10 == 0) & ~F.regexp_like(digits, F.lit("^(.)\\1*$"))


def marked(t: Column) -> Column:
    """The text with MARK before every separated card number that is valid, wherever others begin before it."""
    text = F.concat(F.lit(" "), F.replace(t, F.lit(MARK), F.lit(MARK + AS_IS)))  # no number at the very start: one piece more than numbers
    valid = F.transform(F.regexp_extract_all(text, F.lit(f"(?=({SPACED_CARD}))"), F.lit(1)), lambda c: F.when(_checks(F.regexp_replace(c, "[^0-9]", "")), MARK).otherwise(""))
    joined = F.array_join(F.zip_with(F.split(text, f"(?={SPACED_CARD})", -1), F.concat(F.array(F.lit("")), valid), lambda piece, mark: F.concat(mark, piece)), "")
    return F.substring(joined, F.lit(2), F.length(joined))


def unmarked(t: Column) -> Column:
    return F.replace(F.regexp_replace(t, f"{MARK}(?!{AS_IS})", ""), F.lit(MARK + AS_IS), F.lit(MARK))


def kind_of(m: Column) -> Column:
    """Kind of a candidate whose value is valid, or null."""
    whole = lambda k: F.regexp_like(m, F.lit(f"^(?:{KINDS[k]})$"))
    digits = F.regexp_replace(m, "[^0-9]", "")
    day = F.datediff(_date_of(m), F.to_date(F.lit(FIRST_DAY)))
    return (F.when(whole("email"), "email")
            .when(whole("ipv4"), F.when(_canonical_ip(m), "ipv4"))
            .when(whole("date"), F.when(day.between(0, DAYS[0] * DAYS[1] - 1), "date"))
            .when(whole("ssn"), F.when(~F.regexp_like(m, F.lit(NO_AREA)), "ssn"))
            .when(whole("phone"), F.when(F.length(digits).between(8, 15), "phone"))
            .when(whole("card"), F.when(_checks(digits), "card")))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid value of a kind, in the value's own writing."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    tweak = F.concat(kind, F.length(digits).cast("string"))
    local = F.substring_index(m, "@", 1)
    shown = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    email = F.concat(refill(local, permute_letters(shown, F.lit("email"), key), "[A-Za-z0-9]"), F.substring(m, F.length(local) + 1, F.length(m)))
    pair = permute_pair(_octet(m, 0) * 256 + _octet(m, 1), _octet(m, 2) * 256 + _octet(m, 3), 1 << 16, 1 << 16, F.lit("ipv4"), key)
    ip = F.transform(F.array(pair), lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(p["l"], 8), p["l"] % 256, F.shiftright(p["r"], 8), p["r"] % 256)]))[0]
    a, b = DAYS
    day = F.datediff(_date_of(m), F.to_date(F.lit(FIRST_DAY)))
    moved = F.transform(F.array(permute_pair(F.floor(day / b), day % b, a, b, F.lit("date"), key)), lambda p: F.date_add(F.to_date(F.lit(FIRST_DAY)), (p["l"] * b + p["r"]).cast("int")))[0]
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(digits.alias("v"), F.lit(False).alias("ok")),
                       lambda s, _: F.when(s["ok"], s).otherwise(_checked(permute_letters(s["v"], F.lit("ssn"), key))), lambda s: s["v"])
    # the country code stays, told from the digits alone, so that all writings of a number give one pseudonym; without one the first digit stays
    code = F.when(m.startswith("+"), F.length(F.regexp_extract(digits, COUNTRY, 0))).otherwise(F.lit(1))
    phone = F.concat(F.substring(digits, F.lit(1), code), permute_letters(F.substring(digits, code + 1, F.length(digits)), tweak, key))
    body = permute_letters(F.substring(digits, F.lit(1), F.length(digits) - 1), tweak, key)
    card = F.transform(F.array(body), lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))[0]
    return (F.when(kind == "email", email).when(kind == "ipv4", ip).when(kind == "date", _date_like(m, moved)).when(kind == "ssn", refill(m, walk))
            .when(kind == "phone", refill(m, phone)).when(kind == "card", refill(m, card)).otherwise(m))


def _checked(digits: Column) -> Column:
    return F.transform(F.array(digits), lambda d: F.struct(d.alias("v"), (~F.regexp_like(d, F.lit(NO_AREA))).alias("ok")))[0]


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with valid values in their texts replaced, and the columns ``values`` (found) and ``kinds``.

    Found are mail addresses (the local part is replaced), IPv4 addresses, dates of 1900
    to 2099 (also before a time, with dots, or without leading zeros), social security
    numbers, phone numbers (with a country code, or national: area in brackets, ten digits
    in groups, or a leading 0) and card numbers with a right check digit; candidates that
    are not valid stay and do not hide values that begin inside them. A number with its
    country code gets one pseudonym in all writings; the national form of it gets another,
    since a text does not tell the country. A null text stays null,
    with null counts of nothing: ``values`` 0 and no ``kinds``. Texts without values stay
    as they are, rows with equal texts get equal results, and an empty table gives no rows.
    All columns stay, but the new ones replace columns of their names.
    """
    require(docs, text)
    if not key:
        raise ValueError("a key is needed")
    t = F.col(text)
    # every kind holds a digit or an at sign, so most texts need no more than that search
    has = F.regexp_like(t, F.lit("[0-9@]")) & F.regexp_like(t, F.lit(HOLDS))
    marks = F.regexp_like(t, F.lit(SPACED_CARD)) | t.contains(MARK)
    none = F.array().cast("array<struct<m:string,kind:string,new:string>>")
    out = docs.withColumn("__marked", F.when(has & marks, marked(t))).withColumn("__searched", F.when(has, F.coalesce("__marked", t)))
    u = F.col("__searched")
    met = F.transform(F.regexp_extract_all(u, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("m"), F.replace(m, F.lit(MARK), F.lit("")).alias("v")))
    met = F.transform(met, lambda f: F.struct(f["v"].alias("m"), kind_of(f["v"]).alias("kind")))
    new = F.transform(met, lambda f: F.struct(f["m"].alias("m"), f["kind"].alias("kind"), F.coalesce(pseudonym(f["m"], f["kind"], key), f["m"]).alias("new")))
    out = out.withColumn("__found", F.when(u.isNotNull(), new).otherwise(none))
    pieces = F.split(u, ANY, -1)
    rebuilt = F.array_join(F.zip_with(pieces, F.col("__found"), lambda p, f: F.concat(p, F.coalesce(f["new"], F.lit("")))), "")
    rebuilt = F.when(F.col("__marked").isNotNull(), unmarked(rebuilt)).otherwise(rebuilt)
    valid = F.filter(F.col("__found"), lambda f: f["kind"].isNotNull())
    return out.withColumns({text: F.when(F.size("__found") > 0, rebuilt).otherwise(t), "values": F.size(valid), "kinds": F.array_sort(F.array_distinct(F.transform(valid, lambda f: f["kind"])))}).drop("__found", "__searched", "__marked")
