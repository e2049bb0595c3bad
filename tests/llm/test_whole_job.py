"""Places where an operator once did less than the whole job."""

from __future__ import annotations

import ipaddress
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from equivcheck.llm import chat, decontaminate, pseudonyms, simhash
from test_brute_force import brute_fingerprint, luhn, made, roots


def test_secrets_in_capitals_are_replaced_and_linked(spark):
    low = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    mixed = low[:20].upper() + low[20:]
    out, n = made(spark, [low, low.upper(), mixed, "0" * 40, "G" + low[1:].upper()])
    assert n == [1, 1, 1, 1, 0]
    assert out[0] != low and re.fullmatch("[0-9a-f]{40}", out[0])
    assert out[1] == out[0].upper() and out[2] == out[0]


def test_pipeline_keeps_one_of_each_group_within_the_radius(spark):
    draw = random.Random(5)

    def prose(n):
        return [f"{draw.choice('abcdefgh')}{draw.randrange(500)}" for _ in range(n)]

    texts = []
    for n in (60, 200, 800):
        base = prose(n)
        texts.append(base)
        for changed in (1, 1, 2, 5, n // 4):
            copy = list(base)
            for at in draw.sample(range(n), changed):
                copy[at] = "x" + str(draw.randrange(10**6))
            texts.append(copy)
    # One large group of copies of a long text, with a word changed each.
    hub = prose(1_500)
    texts += [[*hub[:at], "new", *hub[at + 1 :]] for at in range(0, 1_500, 25)]
    rows = [" ".join(x) for x in [*texts, *(prose(40) for _ in range(20))]] + ["", " ", None, "a b", "A  b"]
    fps = [brute_fingerprint(x) for x in rows]
    root = roots(fps, 4)
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(root[f], i)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    assert kept == set(least.values())
    assert len(kept) < len(rows) - 60


def test_shingles_and_radius_are_parameters(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "q r s"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["fp"] for r in simhash.near_duplicates(docs, size=1, radius=2).collect()}
    assert got == {i: simhash.fingerprint((t or "").encode(), 1) for i, t in rows}


def test_columns_may_have_the_names_of_helpers(spark):
    """Each stage of the pipeline and each operator that returns its input's rows."""
    names = ["id", "row", "fp", "least", "digest", "component_id", "__id", "__row", "__text", "__found", "__made", "__clean"]
    names += ["budget", "supply", "__whole", "__left", "__end", "__last", "__hash", "__times", "__before", "__domain", "a.b"]
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen of all these words are here"
    rows = [(i, f"{text} {i} {i * 7} " * (i + 1), "en", "s", 5) for i in range(6)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, "w " * 12)], "item_id long, text string")
    docs = plain.select("*", *[F.lit(name).alias(name) for name in names])
    for df in (plain, docs):
        quality = corpus_pipeline.quality_stage(spark, df, "")
        unique = corpus_pipeline.dedup_stage(spark, df, "")
        clean = decontaminate.clean(df, items)
        hidden = corpus_pipeline.pii_stage(spark, df, "")
        mixed = corpus_pipeline.mixing_stage(spark, df, "")
        for out in (quality, unique, clean, hidden, mixed):
            assert [c for c in out.columns if c != "epoch"] == df.columns
            row = out.first()
            assert row is None or all(row[name] == name for name in df.columns if name in names)
        sizes = [x.count() for x in (quality, unique, clean, hidden, mixed)]
        if df is plain:
            want = sizes
    assert sizes == want and sizes[2] == 6 and sizes[4] > 0


def luhn_valid(draw, n):
    body = "".join(draw.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def iban(country, account):
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{account}"


def test_different_values_have_different_pseudonyms(spark):
    """Valid and invalid values of each kind: no two of them become one, and what is valid stays valid."""
    draw = random.Random(8)

    def digits(n):
        return "".join(draw.choice("0123456789") for _ in range(n))

    ssn = {f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(300)} | {"955-90-6963", "101-11-1014", "666-01-0001", "665-01-0001", "667-01-0001"}
    cards = {luhn_valid(draw, n) for n in (13, 15, 16, 19) for _ in range(40)} | {digits(16) for _ in range(40)} | {"0" * 16}
    ibans = {iban("DE", digits(18)) for _ in range(60)} | {iban("FR", digits(10) + "AB" + digits(11)) for _ in range(20)} | {"DE00" + digits(18)}
    phones = {f"+49151{digits(8)}" for _ in range(40)} | {f"0151 {digits(8)}" for _ in range(40)} | {f"(555) {digits(3)}-{digits(4)}" for _ in range(40)}
    ips = {f"2001:db8::{draw.randrange(1, 65536):x}" for _ in range(30)} | {"fe80::1", "2001:0db8:0:0:0:0:0:1"}
    dates = {f"{draw.randint(1, 28)}.{draw.randint(1, 12)}.2024" for _ in range(60)}
    plain = {f"2024/{m:02d}/{d:02d}" for m in range(1, 14) for d in (1, 5, 31)}
    valid = {
        "ssn": lambda v: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", v),
        "card": lambda v: luhn(v) and set(v) != {"0"},
        "iban": lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1 and "02" <= v[2:4] <= "98",
    }
    for name, values in {"ssn": ssn, "card": cards, "iban": ibans, "phone": phones, "ip": ips, "date": dates, "plain": plain}.items():
        values = sorted(values)
        out, _ = made(spark, values)
        same = {}
        for a, b in zip(values, out, strict=True):
            if name == "ip":  # spellings of one address have one pseudonym
                a = str(ipaddress.ip_address(a))
            if name == "date":
                a = tuple(map(int, a.split(".")))
            assert same.setdefault(b, a) == a, (name, b)
            if name in valid:
                assert bool(valid[name](a)) == bool(valid[name](b))
                assert valid[name](a) or a == b
            elif name in ("phone", "ip"):
                assert re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", b) or name == "ip"
        assert sum(a != b for a, b in zip(values, out, strict=True)) > len(values) / 4


def test_common_formats_are_found(spark):
    values = [
        "+4915123456789", "0151 23456789", "06 12 34 56 78", "(555) 123-4567", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00",
        "ES9121000418450200051332", "5.3.2024", "2024/03/05", "2001:db8:85a3::8a2e:370:7334", "+49 151 23456789",
    ]
    out, n = made(spark, values)
    assert n == [1] * len(values)
    assert all(a != b for a, b in zip(values, out, strict=True))
    assert out[4] == out[5].replace(" ", "") and out[0][3:] == out[10].replace(" ", "")[3:]
    left = ["version 1.2.3", "12:30:45", "C++ std::map", "a::b", "DE12 3456", "10.2024", "31.2.2024", "0 of 12345", "x0151 234567"]
    kept, n = made(spark, left)
    assert kept == left and not any(n)


def test_the_key_is_the_callers(spark):
    df = spark.createDataFrame([(1, "at 2024-03-05 from 10.1.2.3")], "doc_id long, text string")
    one, two, again = (pseudonyms.replace(df, key=k).first()["text"] for k in ("a", "b", "a"))
    assert one == again != two
    before = spark.conf.get(pseudonyms.SETTING, None)
    try:
        spark.conf.unset(pseudonyms.SETTING)
        drawn = pseudonyms.replace(df).first()["text"]
        assert drawn == pseudonyms.replace(df).first()["text"] and drawn not in (one, two)
        spark.conf.set(pseudonyms.SETTING, "a")
        assert pseudonyms.replace(df).first()["text"] == one
    finally:
        if before is not None:
            spark.conf.set(pseudonyms.SETTING, before)


def test_trimmed_quotes_of_several_lines_find_their_message(spark):
    rows = [
        (1, 0, "user", "first line here\nsecond line here\nthird line here"),
        (1, 1, "user", "something else\nsome other line"),
        (1, 2, "assistant", "> first line here\n> second line here\n\nan answer"),
        (1, 3, "user", ">> second line here\n>> third line here\n> an answer\nmore"),
        (1, 4, "user", "> never said\n> nor this\nno parent"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["turn"]: r for r in chat.replies(df).collect()}
    assert [got[i]["parent_turn"] for i in range(5)] == [None, None, 0, 2, None]
    assert [got[i]["thread_turn"] for i in range(5)] == [0, 1, 0, 0, 4]
    assert [got[i]["position"] for i in range(5)] == [0, 3, 1, 2, 4]
