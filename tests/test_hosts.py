"""Hosts: stated rows, and random labels there and back."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import hosts


@pytest.mark.parametrize(("plain", "code"), [("bücher", "bcher-kva"), ("münchen", "mnchen-3ya"), ("例え", "r8jz45g"), ("пример", "e1afmkfd"), ("ñ", "ida"), ("faß", "fa-hia"), ("a😀b", "ab-no82a")])
def test_punycode(plain, code):
    assert hosts.punycode(plain) == code and hosts.from_punycode(code) == plain
    assert plain.encode("punycode").decode() == code


def test_random_labels_there_and_back():
    r = random.Random(1)
    for _ in range(500):
        label = "".join(chr(r.choice([97, 98, 45, 0xE9, 0x3B1, 0x4E00, 0x1F600]) + r.randrange(20)) for _ in range(r.randrange(1, 20)))
        assert hosts.from_punycode(hosts.punycode(label)) == label


@pytest.mark.parametrize(
    ("host", "want"),
    [
        ("EXAMPLE.Com.", ("example.com", "example.com", None)),
        ("Bücher.example", ("xn--bcher-kva.example", "bücher.example", None)),
        ("XN--BCHER-KVA.example", ("xn--bcher-kva.example", "bücher.example", None)),
        ("10.0.0.1", ("10.0.0.1", "10.0.0.1", None)),
        ("[2001:DB8::1]", ("2001:db8::1", "2001:db8::1", None)),
        ("", (None, None, "empty")),
        (None, (None, None, "empty")),
        ("a..b", (None, None, "empty label")),
        ("-a.b", (None, None, "hyphen at an end")),
        ("a" * 64 + ".b", (None, None, "label too long")),
        ("ü" * 60 + ".b", (None, None, "label too long")),
        ("a b.c", (None, None, "invalid character")),
        ("a<b.c", (None, None, "invalid character")),
        ("xn--a-.b", (None, None, "hyphen at an end")),
        ("xn--999999.b", (None, None, "invalid punycode")),
        ("xn--abc-.b", (None, None, "hyphen at an end")),
    ],
)
def test_normal_host(host, want):
    got = hosts.normal_host(host)
    assert got[2] == want[2] and (want[2] or got == want)


def test_public_suffixes(spark):
    want = {
        "www.bbc.co.uk": ("www", "bbc", "co.uk", "bbc.co.uk"),
        "a.b.example.com": ("a.b", "example", "com", "example.com"),
        "example.com": (None, "example", "com", "example.com"),
        "co.uk": (None, None, "co.uk", None),
        "x.y.kawasaki.jp": (None, "x", "y.kawasaki.jp", "x.y.kawasaki.jp"),
        "www.city.kawasaki.jp": ("www", "city", "kawasaki.jp", "city.kawasaki.jp"),
        "www.ck": (None, "www", "ck", "www.ck"),
        "shop.other.ck": (None, "shop", "other.ck", "shop.other.ck"),
        "me.github.io": (None, "me", "github.io", "me.github.io"),
        "host.unknown": (None, "host", "unknown", "host.unknown"),
        "localhost": (None, "localhost", None, "localhost"),
        "10.0.0.1": (None, "10.0.0.1", None, "10.0.0.1"),
        "2001:db8::1": (None, "2001:db8::1", None, "2001:db8::1"),
    }
    rows = [(h,) for h in want] + [("WWW.BBC.co.uk.",), ("example.com",), (None,), ("",)]
    got = hosts.domain_parts(spark.createDataFrame(rows, "host string"), hosts.suffix_rules(spark)).collect()
    assert {r["host"]: (r["subdomain"], r["domain"], r["suffix"], r["registered_domain"]) for r in got} == want and len(got) == len(want)


def test_addresses(spark):
    texts = ["1.2.3.4", "256.1.1.1", "1.2.3", "01.2.3.4", "::", "::1", "1::", "2001:db8::ff00:42:8329", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "12345::", "g::1", ":1::2", "1::2:", "1:2:3:4:5:6:7::", "abc", "a.b", ":::"]

    def kind(t):
        try:
            return f"ipv{ipaddress.ip_address(t).version}"
        except ValueError:
            return None

    rows = spark.createDataFrame([(t,) for t in texts] + [("[::1]",)], "h string").select("h", hosts.address_kind(F.col("h")).alias("k")).collect()
    assert {r["h"]: r["k"] for r in rows} == {t: kind(t) for t in texts} | {"[::1]": "ipv6"}


def test_rows_keep_their_columns(spark):
    got = hosts.normal_hosts(spark.createDataFrame([(1, "É.fr", "x"), (2, None, None)], "id long, host string, note string")).collect()
    assert [tuple(r) for r in got] == [(1, "É.fr", "x", "xn--9ca.fr", "é.fr", None), (2, None, None, None, None, "empty")]
