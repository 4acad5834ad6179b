"""The pseudonyms against a plain Python version of the same networks, and their properties."""

import hashlib
import re
from datetime import date, timedelta

from dockyard.llm import pii

KEY = "dockyard"


def prf(kind, r, half):
    return int(hashlib.sha256(f"{KEY}|{kind}|{r}|{half}".encode()).hexdigest()[:12], 16)


def halves(a, b, na, nb, kind, rounds=range(1, 9), sign=1):
    for r in rounds:
        if r % 2:
            a = (a + sign * prf(kind, r, b)) % na
        else:
            b = (b + sign * prf(kind, r, a)) % nb
    return a, b


def shift(s, other, r, kind):
    out = ""
    for i, c in enumerate(s):
        by = prf(kind, f"{r}|{i}", other)
        base, n = (48, 10) if c.isdigit() else (65, 26) if c.isupper() else (97, 26)
        out += chr((ord(c) - base + by) % n + base)
    return out


def characters(s, kind):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for r in range(1, 9):
        if r % 2:
            a = shift(a, b, r, kind)
        else:
            b = shift(b, a, r, kind)
    return a + b


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10


def put_back(shape, chars, keep):
    it = iter(chars)
    return "".join(c if re.match(keep, c) else next(it) for c in shape)


def expected(x, kind):
    d = re.sub(r"\D", "", x)
    if kind == "ip":
        q = list(map(int, x.split(".")))
        a, b = halves(q[0] * 256 + q[1], q[2] * 256 + q[3], 65536, 65536, "ip")
        return f"{a >> 8}.{a % 256}.{b >> 8}.{b % 256}"
    if kind == "card":
        body = d[0] + characters(d[1:-1], "card")
        return put_back(x, body + str((10 - luhn(body + "0")) % 10), r"\D")
    if kind == "nanp":
        a, b = halves(int(d[-10:-7]) - 200, (int(d[-7:-4]) - 200) * 10000 + int(d[-4:]), 800, 8_000_000, "nanp")
        return put_back(x, d[:-10] + f"{a + 200:03d}{b // 10000 + 200:03d}{b % 10000:04d}", r"\D")
    if kind == "ssn":
        area = int(d[:3])
        a, b = halves(area - 1 - (area > 666), (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898, 99 * 9999, "ssn")
        return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if kind == "email":
        name, top = x.rsplit(".", 1)
        return put_back(name, characters(re.sub("[^A-Za-z0-9]", "", name), "email"), "[^A-Za-z0-9]") + "." + top
    if kind == "phone":
        return put_back(x, d[0] + characters(d[1:], "phone"), r"\D")
    y, m, dd = map(int, x.split("-"))
    n = (date(y, m, dd) - date(1900, 1, 1)).days
    a, b = halves(n // 270, n % 270, 270, 270, "date")
    return (date(1900, 1, 1) + timedelta(days=a * 270 + b)).isoformat()


VALUES = [
    ("ip", "42.144.35.254"),
    ("card", "4041894974608795"),
    ("card", "4041 8949 7460 8795"),
    ("nanp", "+1 (988) 555-2485"),
    ("nanp", "212-555-0100"),
    ("ssn", "123-45-6789"),
    ("ssn", "667-01-0001"),
    ("email", "bosbt.42@mail8.example.com"),
    ("email", "A@b.co"),
    ("date", "2021-02-28"),
    ("phone", "+44 20 7946 0958"),
]
CLEAN = ["4041894974608796", "2021-02-30", "666-45-6789", "300.1.2.3", "Version 2.0. in 1999", "a @ b", "v1.2.3.4.5", "0000000000000000"]


def rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(pii.pseudonymise(df, KEY).collect(), key=lambda r: r.doc_id)]


def test_values_match_plain_version_and_keep_format(spark):
    out = rows(spark, [f"So: {v}, yes" for _, v in VALUES])
    for (kind, v), r in zip(VALUES, out):
        assert r.text == f"So: {expected(v, kind)}, yes", (kind, v)
        assert r.kinds == [kind] and r.n_replaced == 1 and v not in r.text
        assert re.sub(r"\d", "0", r.text) != "" and len(r.text) == len(f"So: {v}, yes") or kind == "ip"
        if kind == "card":
            assert luhn(re.sub(r"\D", "", r.text)) == 0
    assert re.sub(r"\D", "", out[1].text) == re.sub(r"\D", "", out[2].text)  # the same card, written otherwise


def test_network_can_be_undone():
    a, b = halves(17, 5, 270, 270, "date")
    assert halves(a, b, 270, 270, "date", range(8, 0, -1), -1) == (17, 5)


def test_dates_in_other_layouts_stay_linked(spark):
    out = rows(spark, ["2021-03-04", "03/04/2021", "4.3.2021", "25/12/2020", "2020-12-25"])
    y, m, d = out[0].text.split("-")
    assert out[1].text == f"{m}/{d}/{y}" and out[2].text == f"{d}.{m}.{y}"
    y, m, d = out[4].text.split("-")
    assert out[3].text == f"{d}/{m}/{y}"


def test_clean_null_empty_long_and_repeats(spark):
    long = "word " * 200_000 + "42.144.35.254 " + "x" * 100_000
    out = rows(spark, [*CLEAN, None, "", long, "1.2.3.4 and 1.2.3.4"])
    for v, r in zip([*CLEAN, None, ""], out):
        assert r.text == v and r.n_replaced == 0 and r.kinds == []
    assert out[-2].n_replaced == 1 and len(out[-2].text) > 1_000_000
    assert out[-1].text == " and ".join([expected("1.2.3.4", "ip")] * 2)
    empty = spark.createDataFrame([], "doc_id long, text string, _t string, kinds int")
    assert pii.pseudonymise(empty).count() == 0


def test_card_with_other_digits(spark):
    card = "4041 8949 7460 8795"
    shapes = ["{} 03/27", "{} 123", "{} 12", "no. 12 {}", "{}-03/27, due"]
    out = rows(spark, [s.format(card) for s in shapes])
    for s, r in zip(shapes, out):
        whole = re.sub(r"\D", "", re.search(pii.CARD, s.format(card))[0])
        assert luhn(whole) != 0  # or the digits would pass together
        assert r.text == s.format(expected(card, "card")) and r.kinds == ["card"] and r.n_replaced == 1
