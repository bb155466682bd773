"""Values beyond ASCII on the path of a match, against Python's own Unicode rules."""

import re
import unicodedata
from urllib.parse import urlsplit

from weftlink.operators import blocking
from weftlink.plans.model import Mapping

MAPPINGS = [Mapping(k, k, k, k) for k in ("name_or_title", "phone", "email", "domain", "address", "geography")]
VALUES = [
    "Ｃａｆé  Straße ＧｍｂＨ Inc", "ÀÉÎ—õü Ltd.", "STRASSE ß ẞ", "ﬁne ligature Co", "Ǆ ǅ Σίσυφος ΣΑΣ", "١٢٣ شارع Street", "１２３ Main Street", "½ Road", "İstanbul Drive", "日本語　株式会社", "плохой Бульвар_1 avenue", "étude", "x y z",
    "＋１ （555） 012-4670", "٠١٢٣٤٥٦٧٨", "ＪＯＨＮ@Exämple.COM", "a b　@ex.com", "josé@bücher.example", "https://www.Bücher.example/é", "ＷＷＷ.Example.com", "plain ascii Inc", "", "№ 5 ™", "ᏣᎳᎩ", "Ⅷ Road",
]
ENDINGS = {"co", "company", "corp", "corporation", "inc", "incorporated", "llc", "ltd", "limited"}
STREETS = {"avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "street": "st"}


def fold(v):
    return unicodedata.normalize("NFKC", v).strip().casefold()


def text(v):
    return " ".join(re.sub(r"[^\w]+", " ", fold(v)).split())


def name(v):
    words = text(v).split()
    while words and words[-1] in ENDINGS:
        words.pop()
    return " ".join(words)


def phone(v):
    d = re.sub(r"\D", "", unicodedata.normalize("NFKC", v))
    d = d[1:] if len(d) == 11 and d.startswith("1") else d
    return d if len(d) >= 7 else ""


def domain(v):
    v = fold(v)
    host = (urlsplit(v if "://" in v else "//" + v).hostname or "").rstrip(".") if v else ""
    host = host.removeprefix("www.")
    return host if host and " " not in host and "." in host else ""


def email(v):
    v = re.sub(r"\s+", "", fold(v))
    return v if v.count("@") == 1 and v.split("@")[0] and domain(v.split("@")[1]) else ""


def address(v):
    return " ".join(STREETS.get(t, t) for t in text(v).split())


OWN = {"name_or_title": name, "phone": phone, "email": email, "domain": domain, "address": address, "geography": text}


def test_values_beyond_ascii(spark):
    rows = [(f"r{i}", *[v] * len(MAPPINGS)) for i, v in enumerate(VALUES)] + [("mixed", *["Ä", "5550124670", "a@b.example", "b.example", "1 Main Street", "Bonn"]), ("none", *[None] * len(MAPPINGS))]
    df = spark.createDataFrame(rows, "row_id string, " + ", ".join(f"{m.mapping_id} string" for m in MAPPINGS))
    got = {r.row_id: r for r in blocking.prepared(df, "A", MAPPINGS).collect()}
    assert len(got) == len(rows)
    for row_id, *values in rows:
        for m, v in zip(MAPPINGS, values, strict=True):
            assert got[row_id][f"n_{m.mapping_id}"] == OWN[m.kind](v or ""), (m.kind, v)
            assert got[row_id][f"v_{m.mapping_id}"] == (v or "")
