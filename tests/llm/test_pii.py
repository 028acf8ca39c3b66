import json

import pytest

from lodestone.llm import pii

PEOPLE = ["Ada Quilver", "Ada Morrin", "Ben Quilver", "Ben O'Delly", "Cleo van Tarn", "Ada de la Rosa", "Support Desk", "sync-agent", "Deleted User", None, "", "Dora Salver", "Eva Malver"]


@pytest.fixture(scope="module")
def lexicon(spark):
    return pii.learn_names(spark.createDataFrame([(p,) for p in PEOPLE], "display_name string"))


def find(text, lexicon):
    return [(k, text[a:b]) for k, a, b in pii.find(text, lexicon)]


CASES = [
    ("mail ada.q+x@mail.example now", [("email", "ada.q+x@mail.example")]),
    ("at Ada_Q (at) corp.test, b[at]c[dot]example; me at bo dot x at post dot example dot net.", [("email", "Ada_Q (at) corp.test"), ("email", "b[at]c[dot]example"), ("email", "bo dot x at post dot example dot net")]),
    ("git@code.example:a/b.git run x@1.2 and y@4.19", []),
    ("call +49 (0)30 23125088 or (606) 555-0116, 0199 005757, 0017335550155, 363.555.0173, +44 7700 900 979", [("phone", x) for x in ("+49 (0)30 23125088", "(606) 555-0116", "0199 005757", "0017335550155", "363.555.0173", "+44 7700 900 979")]),
    ("call zero three zero two three one two five now", [("phone", "zero three zero two three one two five")]),
    ("Order 4575080961 at 2025-08-15 13:05:33, trace 9364-91-44529-1, build 4980.62.3089, 10.124.191.7, key BC-8723846, 20251046K", []),
    ("SSN 943-10-4228, NINO QQ667734B, NI number QQ 67 11 43 D, DNI 14625019U, passport no. XM1671229, Steuer-IdNr. 01 275 813 227, carte d'identité 45RT84364", [("id_number", x) for x in ("943-10-4228", "QQ667734B", "QQ 67 11 43 D", "14625019U", "XM1671229", "01 275 813 227", "45RT84364")]),
    ("to 1505 Hollin St Apt 24, Altmoor or Flat 3, 65 Tannery Close, Hexley", [("address", "1505 Hollin St Apt 24, Altmoor"), ("address", "Flat 3, 65 Tannery Close, Hexley")]),
    ("in Lindenstr. 97, 01130 Fenwick Hollow; 26 bis rue des Puits, Altmoor; Calle Larga 7, 5º A, Norrholm", [("address", "Lindenstr. 97, 01130 Fenwick Hollow"), ("address", "26 bis rue des Puits, Altmoor"), ("address", "Calle Larga 7, 5º A, Norrholm")]),
    ("77 Retry Lane workers, queue North 6, are idle.", []),
    ("Ms. Ada Quilver, ben quilver, Quilver, Ada and B. Morrin met Ada-Ben O'Delly and Cleo van Tarn; ADA MORRIN too", [("name", x) for x in ("Ada Quilver", "ben quilver", "Quilver, Ada", "B. Morrin", "Ada-Ben O'Delly", "Cleo van Tarn", "ADA MORRIN")]),
    ("The Ada theme, Support Desk and Ada alone", []),
    ("Ada Unsalver wrote", [("name", "Ada Unsalver")]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(lexicon, text, want):
    assert sorted(find(text, lexicon)) == sorted(want)


def test_positions_survive_disguises(lexicon):
    text = "x &amp; \u200bаda@mail.example"  # a Cyrillic letter, an invisible one, an entity
    assert [(k, a) for k, a, _ in pii.find(text, lexicon)] == [("email", 9)]
    tree = json.dumps({"text": 'né "q"\nAda Quilver, +44 7700 900 979'})
    got = pii.find(tree, lexicon)
    assert [(k, tree[a:][:3]) for k, a, _ in got] == [("name", "Ada"), ("phone", "+44")]


def test_redaction_keeps_the_rest(lexicon):
    text = "Hi 🙂 Ada Quilver <ada@mail.example>!"
    assert pii.redact(text, pii.find(text, lexicon)) == "Hi 🙂 [NAME] <[EMAIL]>!"
    assert pii.redact(None, []) is None and pii.find("", lexicon) == [] and pii.find(None, lexicon) == []


def test_table(spark, rows):
    data = [(1, "Ada Quilver called", "Ben Quilver", "x"), (2, None, "Support Desk", "x"), (3, "", None, "x"), (4, "x", "Zed Zorrow 0199 005757", "x")]
    data += [(10 + n, None, p, "x") for n, p in enumerate(PEOPLE[:2])]
    df = spark.createDataFrame(data + data[:2], "fetch_id long, body string, display_name string, pii_type string")
    got = pii.personal_information(df).filter("fetch_id < 10")
    assert rows(got) == [(1, "body", "name", 0), (1, "display_name", "name", 0), (4, "display_name", "name", 0), (4, "display_name", "phone", 11)]
    clean = {r["fetch_id"]: r["body"] for r in pii.redacted(df).collect()}
    assert clean[1] == "[NAME] called" and clean[2] is None and clean[3] == ""
    assert pii.personal_information(df.filter("fetch_id > 99")).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("Reisepassnummer: C01X00147 fehlt", "C01X00147"), ("Personalausweisnummer 123456789", "123456789"), ("see passportnumber XM1671229", "XM1671229"), ("PASSPORTNO.: XM1671229", "XM1671229"),
        ("l'insee 123456789 du client", "123456789"), ("my_dni 14625019U", "14625019U"), ("a compassport XM1671229", None),
    ],
)
def test_compound_labels(lexicon, text, want):
    assert find(text, lexicon) == ([("id_number", want)] if want else [])


def word(n):
    """A name of its own for every number, of letters alone."""
    out = ""
    while n or len(out) < 4:
        out, n = "bcdfghjklmnpqrstvwxz"[n % 20] + "aeiou"[n % 5] + out, n // 20
    return out.capitalize()


def test_many_names_keep_their_filter_apart(spark):
    from pyspark.sql import functions as F

    name = F.udf(lambda n: f"{word(2 * n)} {word(2 * n + 1)}", "string")
    people = spark.range(100_000).select(name(F.col("id")).alias("display_name"))
    lexicon = pii.learn_names(people)
    assert 8 * len(lexicon.bits) == pii.size_for(lexicon.keys.count()) > 6_000_000
    assert all(lexicon.kinds[word(2 * n)] & 1 and lexicon.kinds[word(2 * n + 1)] & 2 for n in range(0, 100_000, 997))
    wrong = sum(bool(lexicon.kinds[word(n)] & 3) for n in range(10_000_000, 10_020_000))
    assert wrong <= 4


def test_mistakes_of_the_filter_are_found_and_scanned_again(spark, rows, monkeypatch):
    monkeypatch.setattr(pii, "LEAST_BITS", 64)
    monkeypatch.setattr(pii, "PER_KEY", 4)  # a filter that takes many words for names
    data = [(n, f"{word(n * 7 + 3)} {word(n * 11 + 5)} met Ada Quilver", "Ada Quilver" if n % 2 else "Ben Morrin") for n in range(200)]
    df = spark.createDataFrame(data, "fetch_id long, body string, display_name string")
    got = pii.personal_information(df).filter("field_name = 'body'")
    assert rows(got) == [(n, "body", "name", len(f"{word(n * 7 + 3)} {word(n * 11 + 5)} met ")) for n in sorted(range(200), key=lambda n: str((n, "body")))]


def test_many_finds_in_one_text(lexicon):
    import time

    text = " ".join(f"a{n}@mail.example" for n in range(20_000))
    began = time.time()
    assert len(pii.find(text, lexicon)) == 20_000 and time.time() - began < 3
