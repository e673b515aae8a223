"""Cases that earlier versions got wrong: names that are words, secrets, hidden attributes, limits of buckets and steps."""

import ipaddress
import random
import re

import pyarrow as pa
import pytest

from scriptorium.llm import common, html_text, pii, substrings

S = pii.Surrogates(b"key of the tests")


@pytest.mark.parametrize("text,kept", [
    ("Mr Young met us. The young people may go. Then Young left.", "The young people may go."), ("Mrs May said so. You may go in may. May I? Ask May.", "You may go in may. May I?"),
    ("Dr Brown ate brown bread", "ate brown bread"), ("Mr John Will came. He will go.", "He will go."), ("Mr Rose rose early; roses rose.", "rose early; roses rose."),
])
def test_ordinary_words_stay(text, kept):
    out, found = pii.surrogate_text(text, S)
    assert kept in out and found and out != text
    for name in ("Mr Young", "Then Young", "Mrs May", "Ask May", "Dr Brown", "John Will", "Mr Rose"):
        assert name not in out


def test_clean_prose_stays():
    words = "The young people may go and will rise early in may to see brown and white roses grow by the long stone wall".split()
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(60)).capitalize() + f". In {rng.randint(1900, 2030)} some {rng.randint(1000, 9999)} {rng.randint(100, 999)} {rng.randint(100, 999)} units, std::max, a::b, 12:30:45."
        assert pii.surrogate_text(text, S) == (text, [])


def planted():
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    letters = lambda n: "aZ3" + "".join(rng.choice("ABCdefGHI0123456789/+") for _ in range(n))
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    for _ in range(40):
        yield "pem", f"x\n-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{(key := letters(60))}\n-----END RSA PRIVATE KEY-----\ny", key
        yield "pgp", f"-----BEGIN PGP PRIVATE KEY BLOCK-----\n{(key := letters(80))}\n", key
        yield "ip6", f"from {(key := ':'.join(hexes(4) for _ in range(8)))} on", key
        yield "ip6", f"from {(key := f'2001:db8:{hexes(3)}1::{hexes(3)}1')}, again", key
        yield "phone", f"call me at {(key := '4' + digits(9))}.", key
        yield "phone", f"phone: {(key := '07' + digits(3) + ' ' + digits(6))} or", key
        yield "phone", f"Tel. {(key := digits(3) + ' ' + digits(3) + ' ' + digits(4))}", key
        yield "secret", f"the AWS secret {(key := letters(37))} is old", key


def test_planted_secrets_are_found():
    hit, total = {}, {}
    for kind, text, value in planted():
        out, found = pii.surrogate_text(text, S)
        total[kind] = total.get(kind, 0) + 1
        hit[kind] = hit.get(kind, 0) + (value not in out)
        assert re.sub(r"\w", "w", out) == re.sub(r"\w", "w", text) or kind == "ip6"
    assert {k: hit[k] / total[k] for k in total} == dict.fromkeys(total, 1.0)


def test_addresses_of_version_6_keep_their_form():
    for value in ("2001:db8:85a3::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:DB8:0:0:1:A:B:C"):
        new = S.replace("ip6", value)
        assert ipaddress.IPv6Address(new) != ipaddress.IPv6Address(value) and new.startswith(value[:4]) and ("::" in new) == ("::" in value) and new.isupper() == value.isupper()
    short, full = S.replace("ip6", "2001:db8:85a3::8a2e:370:7334"), S.replace("ip6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")
    assert ipaddress.IPv6Address(short) == ipaddress.IPv6Address(full)
    many = {S.replace("ip6", f"2001:db8:1:{k:x}::1:{k + 1:x}") for k in range(1, 500)}
    assert len(many) == 499


STORY = "This is a sentence of the story, which is long enough to be its main text. " * 2


@pytest.mark.parametrize("page,shown,gone", [
    (f'<div title="a hidden gem"><p>{STORY}</p></div>', "the story", None), (f'<div class="mt-4 hidden md:block"><p>{STORY}</p></div>', "the story", None),
    (f'<p data-x="the hidden truth">{STORY}</p><p>We know <math>E=mc2</math> holds.</p>', "E=mc2 holds", None), (f"<article><p>{STORY}</p><p><label>Fig. 1</label> shows it</p></article>", "Fig. 1 shows it", None),
    (f'<article><p>{STORY}</p><aside class="pull-quote">Said she</aside><p>{STORY}</p></article>', "Said she", None), (f"<article><p>{STORY}</p><aside>Read on</aside></article>", "the story", "Read on"),
    (f"<div hidden><p>secret {STORY}</p></div><p>{STORY}</p>", "the story", "secret"), (f"<div hidden='until-found' ><p>secret</p></div><p>{STORY}</p>", "the story", "secret"),
    (f'<div><p>{STORY * 2}</p></div><div class="{"x-" * 60}comments"><p>first! {STORY}</p></div>', "the story", "first!"),
])
def test_what_pages_hide(page, shown, gone):
    text = html_text.main_text(page)
    assert shown in text and (gone is None or gone not in text)


def test_no_more_buckets_than_spark_allows(spark):
    rows = spark.createDataFrame([(i, f"{i} " + "same words in many texts " * 10) for i in range(60)], "doc_id long, text string").repartition(8)
    before = {t.name for t in spark.catalog.listTables()}
    want = sorted(map(tuple, substrings.remove_repeats(rows, texts=False).collect()))
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        assert sorted(map(tuple, substrings.remove_repeats(rows, texts=False).collect())) == want
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert {t.name for t in spark.catalog.listTables()} == before


def test_steps_are_cut_by_bytes():
    texts = ["x" * n for n in (10, 5000, 10, 10, 20_000, 10, 10)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    parts = list(common.slices(iter([batch]), 3, 6000))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4], [5, 6]]
    assert [p.num_rows for p in common.slices(iter([batch]), 3)] == [3, 3, 1]
