import random
import re
from ipaddress import IPv6Address

import pytest

from briarlake.llm.pii import KEY, KINDS, Permutation, luhn, pseudonymize, pseudonyms, replace
from briarlake.llm.queries import op10_pii_pseudonyms
from tests.llm import brute

VALUES = {
    "email": ["jo.Doe9@mail.example.com", "x34@a.org"],
    "account": ["4111111111111111", "4111 1111 1111 1111", "9807915762804490", "3782 822463 10005"],
    "phone": ["+1 (017) 555-7713", "555-123-4567", "+49 30 1234 5678", "+44 20 7946 0958", "+44 (0)20 7946 0958", "(212) 555-1234", "01 23 45 67 89", "+33 1 23 45 67 89", "030/1234567", "08-123 456 78", "0171 2345678", "+46 8 123 456 78", "+390612345678"],
    "ssn": ["123-45-6789", "899-99-9999", "001-01-0001"],
    "ip": ["10.0.0.1", "255.255.255.255"],
    "day": ["1980-02-29", "3/4/1999", "13.12.2020", "12/31/2020", "01/02/2003"],
    "iban": ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"],
    "secret": ['token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "api_key: ABCDEF0123456789ABCDEF0123456789"],
}
CLEAN = ["", "No numbers here.", "In 2024 we paid 3,500.25 for 12 of 100; v1.2.3 at 10:30:59, ISBN 0-19-852663-6.", "2024-13-45 and 31/31/2020 and 300.1.2.3 and 000-12-3456", "Section 4.2.1, page 17-19 #5"]


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_permutation_without_fixed_points(size):
    p = Permutation(b"k", "d", size)
    moved = [p.move(x) for x in range(size)]
    assert sorted(moved) == list(range(size)) and all(x != y for x, y in enumerate(moved))
    assert [p.move(y, back=True) for y in moved] == list(range(size))


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_values_move_within_their_format(kind, value):
    text = f"é before {value}, after"
    out, counts = pseudonymize(text)
    assert counts == {kind: 1} and out != text and value not in out
    again, back = pseudonymize(f"other {value}"), pseudonymize(out, back=True)
    assert again[0].removeprefix("other ") == out.removeprefix("é before ").removesuffix(", after")
    assert back[0] == text
    if kind != "ip":
        assert len(out) == len(text)
    assert pseudonymize(text, b"another key")[0] != out


EVERY = [(k, v) for k, vs in VALUES.items() for v in vs if k != "secret"]


def alone(value):
    return pseudonymize(f"x {value} y")[0][2:-2]


@pytest.mark.parametrize("between", [" ", ", ", "; ", "\n", "\t", " / ", " | ", " and "])
def test_values_beside_each_other_are_what_they_are_alone(between):
    for first_kind, first in EVERY:
        for second_kind, second in EVERY:
            text = f"x {first}{between}{second} y"
            out, counts = pseudonymize(text)
            assert out == f"x {alone(first)}{between}{alone(second)} y", text
            assert counts == {first_kind: 2} if first_kind == second_kind else {first_kind: 1, second_kind: 1}
            assert pseudonymize(out, back=True)[0] == text


@pytest.mark.parametrize("after", ["7 pieces", "12 items", "3500 EUR", "(see 4)", "and 5"])
def test_numbers_after_a_value_stay(after):
    for kind, value in EVERY:
        if kind == "phone" and after[0].isdigit() and value in ("(212) 555-1234",):
            continue
        text = f"call {value} {after}"
        assert pseudonymize(text)[0] == f"call {alone(value)} {after}", text


def test_spellings_are_linked():
    digits = lambda x: "".join(c for c in x if c.isalnum())
    assert digits(alone("GB82 WEST 1234 5698 7654 32")) == alone("GB82WEST12345698765432")
    assert digits(alone("+44 (0)20 7946 0958"))[:2] + digits(alone("+44 (0)20 7946 0958"))[3:] == digits(alone("+44 20 7946 0958"))
    assert digits(alone("01 23 45 67 89")) == digits(alone("0123456789"))


def by_hand(text):
    """Phone numbers after + or 0, found apart from the module: every start and end is tried, the longest whole-group number of the plan wins, from the left."""
    plans = {"+44": (9, 10), "+33": (9, 9), "+49": (8, 11), "0": (8, 10)}
    found, at = [], 0
    while at < len(text):
        best = None
        for head, (least, most) in plans.items():
            if text.startswith(head, at) and (at == 0 or not re.match(r"[\w.-]", text[at - 1])):
                for end in range(at + len(head), min(len(text), at + 24) + 1):
                    body = text[at + len(head) : end]
                    if re.fullmatch(r"[\d ]*\d", body) and "  " not in body and least <= len(re.sub(" ", "", body)) <= most and not text[end : end + 1].isdigit():
                        groups = re.findall(r"\d+", text[at:end] if head == "0" else body)
                        if head == "0" and all(len(g) == 2 for g in groups) and len(groups) != 5:
                            continue
                        used, fits = -1 if head == "0" else 0, True
                        for before, g in zip([None, *groups], groups):
                            fits = fits and not (used >= least and len(g) < 3 and before is not None and len(before) != len(g))
                            used += len(g)
                        best = end if fits else best
        if best:
            found.append(text[at:best])
            at = best
        else:
            at += 1
    return found


def test_phones_against_a_finder_by_hand():
    draw = random.Random(12)
    for _ in range(400):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            head = draw.choice(["+44 ", "+33 ", "+49 ", "0", "", ""])
            groups = ["".join(draw.choice("123456789") for _ in range(draw.choice([2, 2, 3, 4, 5]))) for _ in range(draw.randrange(1, 6))]
            parts.append(head + " ".join(groups))
        text = "tel " + draw.choice([" ", ", ", " x "]).join(parts) + "."
        out, counts = pseudonymize(text)
        kept = [m for m in by_hand(text)]
        if set(counts) <= {"phone"} and not re.search(r"(?<![\d+])[1-9]\d{2} \d{3} \d{4}(?!\d)|\d{4} \d{4} \d{4} \d|\d{4} \d{6} \d{4}", text):
            want = text
            for m in kept:
                want = want.replace(m, alone(m), 1)
            assert out == want, text


def test_checks_stay_valid():
    digits = "".join(c for c in pseudonymize("4111 1111 1111 1111")[0] if c.isdigit())
    assert luhn(digits[:-1]) == int(digits[-1])
    assert pseudonymize("4111-1111-1111-1111")[0].replace("-", "") == digits == pseudonymize("4111111111111111")[0]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert pseudonymize(text) == (text, {})


def test_table(spark):
    docs = spark.createDataFrame([(1, "a@b.org", 0), (1, "a@b.org", 0), (None, None, 0), (2, "", 0), (3, "x " * 200_000 + "10.0.0.1", 0)], "doc_id long, text string, n_ip int")
    rows = pseudonyms(docs, KEY).collect()
    assert len(rows) == 5 and sum(r.n_found for r in rows) == 3
    assert {r.text for r in rows if r.doc_id in (None, 2)} == {None, ""}
    assert pseudonyms(docs.limit(0), KEY).count() == 0


def test_query_can_be_undone(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").collect()}
    rows = op10_pii_pseudonyms(spark, brute.SMALL).collect()
    assert len(rows) == len(texts) and sum(r.n_found for r in rows) > 0
    for r in rows:
        assert pseudonymize(r.text, back=True)[0] == texts[r.doc_id]
        assert r.n_found == sum(r[f"n_{k}"] for k in KINDS)
        assert (r.n_found == 0) == (r.text == texts[r.doc_id])


@pytest.mark.parametrize("local", ["иван", "иванов1", "李小龙", "josé", "José", "राम", "ΑΒΓ", "x_é"])
def test_letters_of_every_script_move(local):
    text = f"mail {local}@example.com now"
    out, counts = pseudonymize(text)
    moved = out.removeprefix("mail ").removesuffix("@example.com now")
    assert counts == {"email": 1} and len(moved) == len(local)
    assert not any(a == b == c for a, b, c in zip(local, moved, pseudonymize(text, b"another key")[0][5:], strict=False) if c.isalpha()) and moved != local
    assert pseudonymize(out, back=True)[0] == text


def test_local_part_without_letters_does_not_count():
    assert pseudonymize("mail __@example.com") == ("mail __@example.com", {})


def test_address_before_text_without_spaces():
    out, counts = pseudonymize("a.b@example.com或者")
    assert counts == {"email": 1} and out.endswith("@example.com或者") and not out.startswith("a.b@")


@pytest.mark.parametrize(
    ("kind", "value"),
    [("phone", x) for x in ("0171 1234567", "01 23 45 67 89", "030/1234567", "030 / 123 45 67", "4435555793", "14435555793", "07700 900123", "01711234567", "0171-1234567", "01.23.45.67.89")] + [("day", "12-05-1990"), ("day", "5-12-1990"), ("day", "31-12-2001")],
)
def test_national_phones_and_hyphenated_days(kind, value):
    text = f"call {value}, or"
    out, counts = pseudonymize(text)
    assert counts == {kind: 1} and value not in out and len(out) == len(text)
    assert pseudonymize(out, back=True)[0] == text


@pytest.mark.parametrize("text", ["at 1990-05-12T10:00", "at 1990-05-12T10:00:30Z.", "12.05.1990t1000"])
def test_days_before_a_time(text):
    out, counts = pseudonymize(text)
    assert counts == {"day": 1} and out != text and pseudonymize(out, back=True)[0] == text


def test_numbers_that_are_no_phones_stay():
    for text in ("0.123456789", "stamp 1704067200", "id 00 12", "ISBN 0-19-852663-6", "5432 of 1234567"):
        assert pseudonymize(text) == (text, {})


def _digits(draw, n):
    return "".join(draw.choice("0123456789") for _ in range(n))


def _value(draw):
    d = lambda n: _digits(draw, n)
    h = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    checked = lambda x: x + str(luhn(x))
    sign = draw.choice("./-")
    return draw.choice([
        lambda: draw.choice("abXYéÉя李") + "".join(draw.choice("abcXY019._-éЯ") for _ in range(draw.randrange(8))) + draw.choice(["@x.com", "@mail.example.org", "@bücher.de"]),
        lambda: d(16), lambda: checked("4" + d(11)), lambda: checked("37" + d(12)), lambda: checked("6" + d(17)), lambda: "-".join(d(4) for _ in range(4)), lambda: d(draw.randrange(5, 20)),
        lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: d(10), lambda: f"0{d(2)} {d(4)} {d(4)}",
        lambda: f"+{d(2)} " + " ".join(d(draw.randrange(1, 4)) for _ in range(draw.randrange(2, 6))), lambda: f"({d(3)}) {d(4)}{d(3)}", lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: ".".join(str(draw.randrange(300)) for _ in range(4)), lambda: f"{draw.randrange(1890, 2110)}-{draw.randrange(1, 14):02d}-{draw.randrange(1, 33):02d}",
        lambda: f"{draw.randrange(1, 33)}{sign}{draw.randrange(1, 14)}{sign}{draw.randrange(1890, 2110)}",
        lambda: "2001:" + ":".join(h(draw.randrange(1, 5)) for _ in range(7)), lambda: f"fe80::{h(3)}:{h(4)}", lambda: f"2001:0db8::{h(2)}", lambda: "2001:0db8:0000:0000:0000:0000:0000:" + h(4),
        lambda: f'token = "{h(40)}"', lambda: "GB82WEST12345698765432", lambda: "DE89370400440532013000", lambda: draw.choice(["word", "7", "2020", "(x)", "a.b", "::", "T10:00"]),
    ])()


def test_ten_thousand_mixtures_come_back():
    draw = random.Random(8)
    for _ in range(10_000):
        text = "".join(_value(draw) + draw.choice([" ", ", ", "\n", ". ", ";", "(", "x", "-", "@", ": "]) for _ in range(draw.randrange(1, 6)))
        out, counts = pseudonymize(text)
        assert pseudonymize(out, back=True) == (text, counts)


def test_no_value_lies_within_another():
    out, counts = pseudonymize("to 1234567890123@example.com, ok")
    assert counts == {"email": 1} and pseudonymize(out, back=True)[0] == "to 1234567890123@example.com, ok"


@pytest.mark.parametrize("text", ["1700000000000", "9780306406157", "411111111111112", "601111111111111710", "+289 123 4567", "+1 23 4567 8901", "std::string", "a::b", "10:30:59", "00:1b:44:11:3a:b7", "::1"])
def test_numbers_that_fail_their_check_stay(text):
    assert pseudonymize(f"n {text}, x") == (f"n {text}, x", {})


@pytest.mark.parametrize(
    "values",
    [
        ["Bob@x.com", "bob@x.com", "BOB@x.com"],
        ["émile@x.de", "ÉMILE@x.de"],
        ["1-555-123-4567", "555-123-4567", "+1 555-123-4567", "(555) 123-4567", "+1 (555) 123-4567"],
        ["443-555-5793", "4435555793", "14435555793"],
        ["(030) 1234567", "030 1234567", "030/1234567"],
        ["2001:db8::1", "2001:0db8:0000:0000:0000:0000:0000:0001", "2001:DB8::1"],
        ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"],
    ],
)
def test_spellings_stay_linked(values):
    def bare(x):
        x = pseudonymize(f"v {x} w")[0][2:-2].lower()
        if "@" in x:
            return x
        return IPv6Address(x) if ":" in x else "".join(c for c in x if c.isdigit())[-10:].lstrip("0")

    made = [bare(v) for v in values]
    assert len(set(made)) == 1 and made[0] != bare(values[0] + "0")


def test_nothing_personal_of_the_table_is_left(spark):
    """A finder of its own: no address, number of 9 digits or more, or key of the texts stays in them."""
    finder = re.compile(r"[\w.+-]+@[\w.-]+|(?:\d[ ()./-]{0,2}){9,}|\b[0-9a-f]{40}\b|\b\d+\.\d+\.\d+\.\d+\b")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").collect()}
    out = {r.doc_id: r.text or "" for r in op10_pii_pseudonyms(spark, brute.SMALL).collect()}
    seen = 0
    for d, text in texts.items():
        for m in finder.findall(text):
            seen += 1
            assert m.strip(" ().-/") not in out[d]
    assert seen > 10


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a@b.org", "f", "m", "d")], "doc_id long, text string, _found string, _made string, `a.b` string")
    out = replace(docs, b"k")
    assert out.columns == docs.columns and out.drop("text").collect() == docs.drop("text").collect()
    assert replace(docs, b"k", found="counts").first().counts.n_email == 1
