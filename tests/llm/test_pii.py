import pytest

from crawlspan.llm import pii

PARTS = [(g, "given") for g in ("Ilka", "Rose", "Tobrin", "Will")] + [(f, "family") for f in ("Wexacott", "Helacott", "Pellacott", "Dunacott", "Velacott", "Lindström", "Page")]
NAMES = pii.Names(PARTS)

CASES = [
    ("Mail <jo.do+x@mx1.site.co.example>, or info (at) shop (dot) test now", [("email", "jo.do+x@mx1.site.co.example"), ("email", "info (at) shop (dot) test")]),
    ("a at b dot c-d dot example did; x[at]y-z[dot]co[dot]example. mailto:Q_1@w.test", [("email", "a at b dot c-d dot example"), ("email", "x[at]y-z[dot]co[dot]example"), ("email", "Q_1@w.test")]),
    ("hero-6@2x.png @media @user/pkg@3.4.1 [a-z]+@[a-z]+ look at example.com", []),
    ("Tel. +49 (0)30 23125-977 4376 parts; Call (646) 555-0117 or 1.312.555.0114, Tel.: 4155550155", [("phone", "+49 (0)30 23125-977"), ("phone", "(646) 555-0117"), ("phone", "1.312.555.0114"), ("phone", "4155550155")]),
    ("01 99 00 74 92 / +44 (0)1632 960 158; 020 7946 0339", [("phone", "01 99 00 74 92"), ("phone", "+44 (0)1632 960 158"), ("phone", "020 7946 0339")]),
    ("Order no. 966-44-1037, SKU 912-35-4419, Ticket 555-0199-86, 192.0.2.76, GTIN 40694384955, Version 10.58.0.24", []),
    ("SSN: 927-94-2823. My social security number is 998738934, ok. (935-83-1324 is my social security no)", [("id_number", "927-94-2823"), ("id_number", "998738934"), ("id_number", "935-83-1324")]),
    ("NI no.: QQ 55 36 06 C, Model MK 45 11 82 C. Steuer-ID: 00 138 153 001 NIE: X-0155095-Q DNI 00008186Z passport XZ 6621155", [("id_number", x) for x in ("QQ 55 36 06 C", "00 138 153 001", "X-0155095-Q", "00008186Z", "XZ 6621155")]),
    ("Visit us at 35 Hollnick Lane #38, 00945 Town or 271 bis avenue des Orfraies, and Eulenweg 45a or Calle Almendrillo nº 201", [("address", x) for x in ("35 Hollnick Lane #38", "271 bis avenue des Orfraies", "Eulenweg 45a", "Calle Almendrillo nº 201")]),
    ("Article 5 Street Lamps. Calle Mayor style lamps are back in size 15. Along Larkmoor Road for 12 miles.", []),
    ("Written by Ilka Wexacott. cc Caldwin van Helacott Pages; Dear Ms Velacott, Tobrin, As ROSE LINDSTRÖM told us", [("person_name", x) for x in ("Ilka Wexacott", "Caldwin van Helacott", "Velacott, Tobrin", "ROSE LINDSTRÖM")]),
    ("Меня зовут Анна Новак-Ким, ул. Ленина, д. 5а. Автор текста неизвестен. κ. Ελένη Παππά", [("person_name", "Анна Новак-Ким"), ("address", "ул. Ленина, д. 5а"), ("person_name", "Ελένη Παππά")]),
    ("Regards,\nTobrin Zelacott\nWill Page open? Rose gold. Velacott Garden Press", [("person_name", "Tobrin Zelacott")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_found(text, want):
    got = [(kind, text[a:b]) for a, b, kind in pii.find(text, NAMES)]
    assert sorted(got) == sorted(want)


def test_frames(spark):
    rows = [(1, CASES[0][0] + " " + CASES[0][0], "c"), (2, None, "c"), (3, "", "c"), (4, "nothing", "c"), (5, "x " * 200_000 + "SSN: 927-94-2823", "c"), (1, "SSN: 927-94-2823", "c")]
    df, names = spark.createDataFrame(rows, "k long, t string, kind string"), spark.createDataFrame(PARTS + [(None, "given")], "name_part string, part_kind string")
    got = sorted(tuple(r) for r in pii.entities(df, names, id="k", text="t", key="s").collect())
    assert got == [(1, "email", "info (at) shop (dot) test"), (1, "email", "jo.do+x@mx1.site.co.example"), (1, "id_number", "927-94-2823"), (5, "id_number", "927-94-2823")]
    texts = {r.k: r for r in pii.redacted(df.filter("k != 1"), names, id="k", text="t", key="s").collect()}
    assert texts[2].masked is None and texts[3].masked == "" and texts[4].pseudonymous == "nothing" and texts[5].masked.endswith("SSN: [ID_NUMBER_1]")
    assert pii.entities(df.limit(0), names, id="k", text="t", key="s").collect() == []
    assert pii.entities(df, names.limit(0), id="k", text="t", key="s").count() == 4


def test_surrogates_keep_form_and_identity():
    text = "Written by Ilka Wexacott. cc Wexacott, Ilka Mail jo@site.test or jo (at) site (dot) test. Tel. +49 (0)30 23125-977. cc ROSE LINDSTRÖM and I. Wexacott"
    found = [*pii.find(text, NAMES), (text.index("I. W"), len(text), "person_name")]
    one = pii.Surrogates(b"k")
    new = {text[a:b]: one.replace(kind, text[a:b]) for a, b, kind in found}
    given, family = new["Ilka Wexacott"].split()
    assert new["Wexacott, Ilka"] == f"{family}, {given}" and new["I. Wexacott"] == f"{given[0]}. {family}" and given.endswith("a")
    assert new["ROSE LINDSTRÖM"].isupper() and new["+49 (0)30 23125-977"].startswith("+49 (0)") and len(new["+49 (0)30 23125-977"]) == 19
    assert new["jo@site.test"].replace("@", " (at) ").replace(".", " (dot) ") == new["jo (at) site (dot) test"]
    parts = {w.casefold() for x in new for w in pii.WORD_PART.findall(x) if len(w) > 1}
    assert not parts & {w.casefold() for k, x in new.items() if "@" not in k and "(at)" not in k for w in pii.WORD_PART.findall(x)}
    whole = lambda s: pii.rewritten(text, [(a, b, s.replace(kind, text[a:b])) for a, b, kind in sorted(found)])
    assert whole(one) == whole(pii.Surrogates(b"k")) != whole(pii.Surrogates(b"other"))
    with pytest.raises(ValueError, match="key"):
        pii.Surrogates(b"")


def test_surrogates_are_one_to_one_over_all_texts():
    surrogates = pii.Surrogates(b"k")
    many = [("person_name", f"{g} {f}") for g in ("Anna", "Anne", "Ana", "Ilka", "Ilke", "Анна", "Ελένη", "Zoë", "花子") for f in ("Novak", "Jansen", "Janson", "Новак", "O'Neill", "Lindström", "Wexacott")]
    many += [("id_number", f"{i:03d}-00-0001") for i in range(500)] + [("phone", f"+49 30 {i:04d}") for i in range(500)] + [("id_number", str(i)) for i in range(10)]
    many += [("email", f"a{i}@b.test") for i in range(300)] + [("address", f"{i} Hollnick Lane") for i in range(100)] + [("email", "x" * 300 + f"{i}@b.test") for i in range(20)]
    new = {x: surrogates.replace(*x) for x in many}
    assert len({(k, v) for (k, _), v in new.items()}) == len(many)
    assert all(v.casefold() != text.casefold() and len(v) == len(text) for (_, text), v in new.items())
    assert all(v.endswith(" Lane") for (k, _), v in new.items() if k == "address") and all("\u0400" <= c <= "\u04ff" for c in new["person_name", "Анна Новак"].replace(" ", ""))


@pytest.mark.parametrize("n", [2, 3, 7, 10, 101, 676])
def test_cycle_goes_through_all(n):
    surrogates, x, seen = pii.Surrogates(b"k"), 0, []
    for _ in range(n):
        seen.append(x)
        x = surrogates.cycle("t", x, n)
    assert x == 0 and sorted(seen) == list(range(n))


def test_items_are_those_of_the_texts(spark):
    texts = spark.createDataFrame([(i, f"cc Ilka Wexacott{'' if i % 2 else ' jo@site.test'} cc Tobrin Velacott") for i in range(6)], "k long, t string")
    names = spark.createDataFrame(PARTS, "name_part string, part_kind string")
    rows = pii.items(texts, names, id="k", text="t", key="s").collect()
    assert {(r.kind, r.found) for r in rows} == {("person_name", "Ilka Wexacott"), ("person_name", "Tobrin Velacott"), ("email", "jo@site.test")}
    by = {}
    for r in rows:
        by.setdefault(r.found, set()).add(r.surrogate)
    assert all(len(v) == 1 for v in by.values()) and len({*map(min, by.values())}) == 3
    whole = {r.k: r for r in pii.redacted(texts, names, id="k", text="t", key="s").collect()}
    assert all(r.surrogate in whole[r.k].pseudonymous and r.placeholder in whole[r.k].masked and r.found not in whole[r.k].pseudonymous for r in rows)
    assert whole[1].masked == "cc [PERSON_NAME_1] cc [PERSON_NAME_2]"


def test_one_long_line():
    text = "Velacott, Ilka; " * 20_000
    assert len(pii.find(text, NAMES)) == 20_000
