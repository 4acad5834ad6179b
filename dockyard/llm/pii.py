"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

A pattern proposes values; each is validated for what it would be (calendar, Luhn digit, octets, numbering
plan), and only then replaced by a keyed permutation of its own format. The permutations are alternating
Feistel networks whose round function is SHA-256 over key, kind, round and the other half:

* date: day number within 1900-01-01 to 2099-08-05 (270 * 270 days), halves modulo 270;
* IPv4 address: halves of 16 bits;
* US social security number: area (898 values) and the rest (99 * 9999);
* North American phone number: area code and the rest, both without leading 0 or 1;
* other phone number after ``+``, and e-mail address without its top-level domain: halves of characters,
  digits, small and capital letters each shifted among their own kind;
* payment card: first digit kept, the others but the last permuted, the last one made to fit.

Equal values get equal pseudonyms in every document, whatever separators they are written with; different
values of a kind get different ones. Whoever has the key can undo it. There is no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockyard.llm.shared import table

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IPV4 = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)"
DATE = (
    r"(?<![\w./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d{1,2}/\d{1,2}/(?:19|20)\d\d|\d{1,2}\.\d{1,2}\.(?:19|20)\d\d)(?![\w/-]|\.\d)"
)
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
NANP = r"(?<![\w+(])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?!\w|-\d)"
PHONE = r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\w|-\d)"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
PATTERN = "|".join([EMAIL, IPV4, DATE, SSN, NANP, PHONE, CARD])
ROUNDS = 8
DAY0 = "1900-01-01"


def _prf(key: str, kind: str, r: Column, half: Column) -> Column:
    """48 bits that depend on the key, the kind, the round and the half that stays."""
    told = F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(told, 256), 1, 12), 16, 10).cast("long")


def _halves(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str) -> Column:
    """Alternating Feistel network over two numbers: struct of ``a`` and ``b``."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        left = F.struct(((s["a"] + _prf(key, kind, r, s["b"])) % size_a).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), ((s["b"] + _prf(key, kind, r, s["a"])) % size_b).alias("b"))
        return F.when(r % 2 == 1, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _shift(chars: Column, other: Column, r: Column, key: str, kind: str) -> Column:
    def one(c: Column, i: Column) -> Column:
        by = _prf(key, kind, F.concat_ws("|", r.cast("string"), i.cast("string")), other)
        move = lambda base, n: F.chr((F.ascii(c) - base + by) % n + base)
        return (
            F.when(c.between("0", "9"), move(48, 10))
            .when(c.between("A", "Z"), move(65, 26))
            .when(c.between("a", "z"), move(97, 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(chars, ""), one), "")


def _characters(s: Column, key: str, kind: str) -> Column:
    """Alternating Feistel network over the halves of a string of letters and digits."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(s.substr(F.lit(1), half).alias("a"), s.substr(half + 1, F.length(s)).alias("b"))

    def step(p: Column, r: Column) -> Column:
        left = F.struct(_shift(p["a"], p["b"], r, key, kind).alias("a"), p["b"].alias("b"))
        right = F.struct(p["a"].alias("a"), _shift(p["b"], p["a"], r, key, kind).alias("b"))
        return F.when(r % 2 == 1, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda p: F.concat(p["a"], p["b"]))


def _put_back(shape: Column, chars: Column, kept: str = "[^A-Za-z0-9]") -> Column:
    """``chars`` in the places of the characters of ``shape`` that don't match ``kept``."""
    letters = F.split(shape, "")
    return F.array_join(
        F.transform(
            letters,
            lambda c, i: F.when(c.rlike(kept), c).otherwise(
                chars.substr(F.length(F.regexp_replace(shape.substr(F.lit(1), i + 1), kept, "")), F.lit(1))
            ),
        ),
        "",
    )


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    each = F.transform(
        F.split(F.reverse(d), ""),
        lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(
            c.cast("int")
        ),
    )
    return F.aggregate(each, F.lit(0), lambda s, v: s + v) % 10


def _day(x: Column) -> Column:
    """The date that is written: year first with dashes, day first with dots, and with slashes month first if that can be."""
    slash = F.split(x, "/")
    dot = F.split(x, r"\.")
    ok = lambda m, d: m.cast("int").between(1, 12) & d.cast("int").between(1, 31)
    us = F.when(ok(slash[0], slash[1]), F.try_to_date(F.concat_ws("-", slash[2], F.lpad(slash[0], 2, "0"), F.lpad(slash[1], 2, "0"))))
    eu = F.when(ok(slash[1], slash[0]), F.try_to_date(F.concat_ws("-", slash[2], F.lpad(slash[1], 2, "0"), F.lpad(slash[0], 2, "0"))))
    dots = F.try_to_date(F.concat_ws("-", dot[2], F.lpad(dot[1], 2, "0"), F.lpad(dot[0], 2, "0")))
    return F.when(x.contains("/"), F.coalesce(us, eu)).when(x.contains("."), dots).otherwise(F.try_to_date(x))


def kind_of(x: Column) -> Column:
    """What a proposed value is, if it is valid; else null."""
    whole = lambda p: x.rlike(f"^(?:{p})$")
    day = F.datediff(_day(x), F.to_date(F.lit(DAY0)))
    d = _digits(x)
    return (
        F.when(x.contains("@"), F.lit("email"))
        .when(whole(IPV4), F.lit("ip"))
        .when(whole(DATE), F.when(day.between(0, 270 * 270 - 1), F.lit("date")))
        .when(whole(SSN), F.when(x.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"), F.lit("ssn")))
        .when(whole(NANP), F.lit("nanp"))
        .when(x.startswith("+"), F.when(F.length(d).between(7, 15), F.lit("phone")))
        .when(F.length(d).between(13, 19), F.when((_luhn(d) == 0) & ~d.rlike("^(.)\\1*$"), F.lit("card")))
    )


def _card_within(x: Column) -> Column:
    """Start and end of the longest valid card between separators within a run of digits that is no card as a whole."""
    at = F.sequence(F.lit(1), F.length(x))
    gap = lambda i: x.substr(i, F.lit(1)).isin(" ", "-")
    starts = F.filter(at, lambda i: (i == 1) | gap(i - 1))
    ends = F.filter(at, lambda i: (i == F.length(x)) | gap(i + 1))
    parts = F.flatten(
        F.transform(starts, lambda i: F.transform(ends, lambda j: F.struct((j - i).alias("n"), (-i).alias("i"), j.alias("j"))))
    )
    fits = F.filter(parts, lambda s: (s["n"] >= 12) & (kind_of(x.substr(-s["i"], s["n"] + 1)) == "card"))
    best = F.array_max(fits)
    return F.when(x.rlike(f"^(?:{CARD})$") & best.isNotNull(), F.struct((-best["i"]).alias("i"), best["j"].alias("j")))


def pseudonym(x: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym in its own format; the value itself where the kind is null."""
    d = _digits(x)
    quad = F.split(x, r"\.")
    number = lambda p: p.cast("long")
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")

    ip = F.transform(
        F.array(_halves(number(quad[0]) * 256 + number(quad[1]), number(quad[2]) * 256 + number(quad[3]), 65536, 65536, key, "ip")),
        lambda s: F.concat_ws(".", F.shiftright(s["a"], 8), s["a"] % 256, F.shiftright(s["b"], 8), s["b"] % 256),
    )[0]

    day = F.datediff(_day(x), F.to_date(F.lit(DAY0)))
    slash = F.split(x, "/")
    month_first = F.when(
        slash[0].cast("int").between(1, 12) & slash[1].cast("int").between(1, 31),
        F.try_to_date(F.concat_ws("-", slash[2], F.lpad(slash[0], 2, "0"), F.lpad(slash[1], 2, "0"))).isNotNull(),
    ).otherwise(F.lit(False))
    date = F.transform(
        F.transform(
            F.array(_halves(F.floor(day / 270), day % 270, 270, 270, key, "date")),
            lambda s: F.date_add(F.to_date(F.lit(DAY0)), (s["a"] * 270 + s["b"]).cast("int")),
        ),
        lambda t: F.when(x.contains("/"), F.when(month_first, F.date_format(t, "MM/dd/yyyy")).otherwise(F.date_format(t, "dd/MM/yyyy")))
        .when(x.contains("."), F.date_format(t, "dd.MM.yyyy"))
        .otherwise(F.date_format(t, "yyyy-MM-dd")),
    )[0]

    area = number(d.substr(1, 3))
    ssn = F.transform(
        F.array(
            _halves(
                area - 1 - F.when(area > 666, 1).otherwise(0),
                (number(d.substr(4, 2)) - 1) * 9999 + number(d.substr(6, 4)) - 1,
                898,
                99 * 9999,
                key,
                "ssn",
            )
        ),
        lambda s: F.concat_ws(
            "-",
            pad(s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0), 3),
            pad(F.floor(s["b"] / 9999) + 1, 2),
            pad(s["b"] % 9999 + 1, 4),
        ),
    )[0]

    ten = F.right(d, F.lit(10))
    nanp = F.transform(
        F.array(
            _halves(
                number(ten.substr(1, 3)) - 200,
                (number(ten.substr(4, 3)) - 200) * 10000 + number(ten.substr(7, 4)),
                800,
                8_000_000,
                key,
                "nanp",
            )
        ),
        lambda s: _put_back(
            x,
            F.concat(
                d.substr(F.lit(1), F.length(d) - 10),
                pad(s["a"] + 200, 3),
                pad(F.floor(s["b"] / 10000) + 200, 3),
                pad(s["b"] % 10000, 4),
            ),
            "[^0-9]",
        ),
    )[0]

    phone = F.transform(
        F.array(F.concat(d.substr(1, 1), _characters(d.substr(F.lit(2), F.length(d)), key, "phone"))),
        lambda c: _put_back(x, c, "[^0-9]"),
    )[0]

    body = F.concat(d.substr(1, 1), _characters(d.substr(F.lit(2), F.length(d) - 2), key, "card"))
    card = F.transform(
        F.transform(F.array(body), lambda c: F.concat(c, ((10 - _luhn(F.concat(c, F.lit("0")))) % 10).cast("string"))),
        lambda c: _put_back(x, c, "[^0-9]"),
    )[0]

    name = F.regexp_replace(x, r"\.[A-Za-z]+$", "")
    email = F.transform(
        F.array(_characters(F.regexp_replace(name, "[^A-Za-z0-9]", ""), key, "email")),
        lambda c: F.concat(_put_back(name, c), F.regexp_extract(x, r"\.[A-Za-z]+$", 0)),
    )[0]
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "date", date)
        .when(kind == "ssn", ssn)
        .when(kind == "nanp", nanp)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .otherwise(x)
    )


def pseudonymise(docs: DataFrame, key: str = "dockyard", text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then ``text`` with pseudonyms, ``n_replaced`` (int) and ``kinds`` (sorted, distinct).

    A null text stays null with 0 replaced; a text without valid values stays as it is, byte for byte. Values
    that only look the part (a wrong Luhn digit, the 31st of April) stay too. Texts of any length are read whole.
    Repeated rows are each treated; an empty table gives an empty result; other columns are not read. Kept columns
    may have any name but those of the three results.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_keep"), F.col(text).alias("_t"))
    hits = F.when(F.col("_t").rlike("[0-9@]"), F.regexp_extract_all("_t", F.lit(PATTERN), 0))
    told = F.transform(F.col("_hits"), lambda x: F.struct(x.alias("v"), kind_of(x).alias("k")))
    # A card may be followed or preceded by other digits, such as an expiry date or a code: these stay as they are.
    found = F.transform(F.col("_told"), lambda s: F.struct(s.alias("s"), F.when(s["k"].isNull(), _card_within(s["v"])).alias("c")))
    judged = F.transform(
        F.col("_found"),
        lambda f: F.when(
            f["c"].isNotNull(),
            F.struct(
                f["s"]["v"].substr(f["c"]["i"], f["c"]["j"] - f["c"]["i"] + 1).alias("v"),
                F.lit("card").alias("k"),
                f["s"]["v"].substr(F.lit(1), f["c"]["i"] - 1).alias("a"),
                f["s"]["v"].substr(f["c"]["j"] + 1, F.length(f["s"]["v"])).alias("z"),
            ),
        ).otherwise(F.struct(f["s"]["v"].alias("v"), f["s"]["k"].alias("k"), F.lit("").alias("a"), F.lit("").alias("z"))),
    )
    new = F.transform(F.col("_judged"), lambda s: F.concat(s["a"], pseudonym(s["v"], s["k"], key), s["z"]))
    gaps = F.split("_t", PATTERN, -1)
    out = F.array_join(F.zip_with(gaps, F.col("_new"), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    kinds = F.filter(F.col("_judged")["k"], lambda k: k.isNotNull())
    return (
        rows.withColumn("_hits", hits)
        .withColumn("_told", told)
        .withColumn("_found", found)
        .withColumn("_judged", judged)
        .withColumn("_new", new)
        .select(
            *[F.col("_keep")[c].alias(c) for c in keep],
            F.when(F.size(kinds) > 0, out).otherwise(F.col("_t")).alias("text"),
            F.greatest(F.lit(0), F.size(kinds)).alias("n_replaced"),
            F.array_sort(F.array_distinct(F.coalesce(kinds, F.array().cast("array<string>")))).alias("kinds"),
        )
    )


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))
