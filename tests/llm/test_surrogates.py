import re

import pytest

from ledgerloom.llm import surrogates as S

TEXT = (
    "Mail Ann.Lee7@mail.example.com or ann.lee7@MAIL.example.com from 97.51.17.173, call +1 (415) 555-2671 or 415-555-2671. "
    'Card 4111 1111 1111 1111 and 4111111111111111. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" Mrs. Clara Weber met Mr Weber and WEBER. '
    "Г-жа Анна Иванова, Herr Weber."
)


def by_kind(text):
    out = {}
    for a, b, kind, canonical in S.find_entities(text):
        out.setdefault(kind, []).append((text[a:b], canonical))
    return out


def test_detection():
    found = by_kind(TEXT)
    assert {c for _, c in found["email"]} == {"ann.lee7@mail.example.com"} and len(found["email"]) == 2
    assert [s for s, _ in found["ip"]] == ["97.51.17.173"] and len(found["phone"]) == 2 and len(found["card"]) == 2
    assert {c for _, c in found["card"]} == {"4111111111111111"} and len(found["secret"]) == 1
    assert found["given:latin:f"] == [("Clara", "clara")] and [s for s, _ in found["family:latin"]] == ["Weber", "Weber", "Weber"]
    assert found["given:cyrillic:f"] == [("Анна", "анна")] and found["family:cyrillic"] == [("Иванова", "иванова")]
    for clean in ("", "plain words, 12 of them", "version 1.2.3", "in 1999. 300", "a@b", "999.1.1.1"):
        assert S.find_entities(clean) == []


def test_replacement_keeps_format_and_coreference(spark):
    rows = [(1, TEXT, 5), (2, "Again " + TEXT, 6), (3, "nothing here", 7), (4, None, 8), (5, "", 9), (None, "x.1@m.example.com", 1), (1, TEXT, 5)]
    df = spark.createDataFrame([(i, t, n, "z") for i, t, n in rows], "doc_id long, text string, id long, kind string")
    out = S.replaced(df, count_col="n_entities").collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["doc_id", "text", "id", "kind", "n_entities"]
    texts = {}
    for r in out:
        texts.setdefault(r.doc_id, []).append(r.text)
    assert texts[3] == ["nothing here"] and texts[4] == [None] and texts[5] == [""] and texts[1][0] == texts[1][1]
    got = texts[1][0]
    assert texts[2] == ["Again " + got]
    for gone in ("Ann.Lee7", "97.51.17.173", "555-2671", "4111", "04dbebab", "Clara", "Mr Weber", "Анна", "Иванова"):
        assert gone not in got
    found = by_kind(got)
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in by_kind(TEXT).items()}
    assert len({c for _, c in found["email"]}) == 1 and len({c for _, c in found["card"]}) == 1 and len({c for _, c in found["family:latin"]}) == 1
    shown = found["card"][0][0]
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", shown) and S.luhn(shown.replace(" ", ""))
    assert re.fullmatch(r"\+1 \(415\) 555-\d{4}", found["phone"][0][0]) and re.fullmatch("[0-9a-f]{40}", found["secret"][0][0])
    assert found["given:latin:f"][0][1] in {n.lower() for n in S.GIVEN["latin", "f"]} and S.script_of(found["family:cyrillic"][0][0]) == "cyrillic"
    other = {r.text for r in S.replaced(df, key=b"another key").collect() if r.doc_id == 1}
    assert got not in other
    assert S.replaced(df.limit(0)).collect() == []


def test_collisions_are_settled(spark):
    rows = [("ip", f"v{i:03d}") for i in range(40)] + [("card", f"v{i}") for i in range(5)]
    entities = spark.createDataFrame(rows, "kind string, canonical string")

    def draw(key, kind, canonical, attempt):  # 8 draws for 40 values at first; some are values themselves
        return f"v{int(canonical[1:]) % 8:03d}" if attempt == 0 else f"s{int(canonical[1:]) % (8 * attempt)}-{attempt}"

    got = S.assign(entities, draw=draw).collect()
    assert sorted((r.kind, r.canonical) for r in got) == sorted(rows)
    assert len({(r.kind, r.replacement) for r in got}) == len(rows)
    known = set(rows)
    assert not any((r.kind, r.replacement) in known for r in got)


@pytest.mark.parametrize(
    "kind, shown",
    [("phone", p) for p in ("+15551234567", "5551234567", "15551234567", "+44 20 7946 0958", "020 7946 0958", "02079460958", "+33 1 23 45 67 89", "+49 (30) 901820", "+1 (415) 555-2671", "\uff14\uff11\uff15-\uff15\uff15\uff15-\uff12\uff16\uff17\uff11")]
    + [("ssn", "123-45-6789"), ("ssn", "123 45 6789")]
    + [("ip6", "2001:db8:85a3:0:0:8a2e:370:7334"), ("ip6", "fe80::1"), ("ip6", "::1"), ("ip6", "2001:DB8::8A2E")]
    + [("secret", k) for k in ("AKIA" + "Q7" * 8, "ghp_" + "aB3" * 12, "sk-" + "aB3" * 8, "xoxb-1234-abcdEF", "0a" * 16, "0A" * 32, "AIza" + "aB3_-" * 7, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF2")],
)
def test_shapes(spark, kind, shown):
    for text in (shown, f"see {shown}, or ({shown}).", f"end {shown}"):
        assert [(text[a:b], k) for a, b, k, _ in S.find_entities(text)] == [(shown, kind)] * text.count(shown)
    other = S.as_shown(shown, kind, S.surrogate(S.KEY, kind, S.find_entities(shown)[0][3], 0))
    assert other != shown and [e[2] for e in S.find_entities(other)] == [kind]
    assert spark.createDataFrame([(shown,)], "text string").filter(S.may_hold(S.F.col("text"))).count() == 1


def test_what_only_looks_like_an_entity():
    for clean in ("12:30:45", "std::vector a::b", "on 2024-01-15 10:20", "3.1415926535 and 0.0123456789", "1700000000", "1,234,567,890.50", "01-02-2003"):
        assert S.find_entities(clean) == [], clean


def names_in(text):
    return [text[a:b] for a, b, k, _ in S.find_entities(text) if k.startswith(("given", "family"))]


def test_names_of_any_length_with_initials_and_apostrophes():
    assert names_in("Mr Juan Carlos Garcia Lopez left") == ["Juan", "Carlos", "Garcia", "Lopez"]
    assert names_in("Mr. O'Brien, Ms D’Arcy and Mr. Weber's") == ["O'Brien", "D’Arcy", "Weber"]
    assert names_in("Dr. J. Smith and Dr. J.R. Smith-Jones, Mr John F Kennedy") == ["J.", "Smith", "J.", "R.", "Smith", "Jones", "John", "F", "Kennedy"]
    assert names_in("Mr Weber I think. Mr Weber The end") == ["Weber", "Weber"]


def test_bare_mentions_get_the_surrogate_of_the_name(spark):
    rows = [(1, "Mrs. Clara Weber spoke; Weber said, WEBER! Clara's weber-like O'Brien Webern. Mr. O'Brien left. O’BRIEN?"), (2, "Weber alone, and Dr. J. Weber.")]
    out = {r.doc_id: r for r in S.replaced(spark.createDataFrame(rows, "doc_id long, text string"), count_col="n").collect()}
    got = re.fullmatch(r"Mrs\. (\w+) (\w+) spoke; (\w+) said, (\w+)! (\w+)'s weber-like (\w+) Webern\. Mr\. (\w+) left\. (\w+)\?", out[1].text).groups()
    assert got[1] == got[2] != "Weber" and got[3] == got[1].upper() and got[4] == got[0] != "Clara" and got[5] == got[6] and got[7] == got[5].upper()
    assert out[1].n == 8
    assert re.fullmatch(rf"{got[1]} alone, and Dr\. [A-Z]\. {got[1]}\.", out[2].text) and out[2].n == 3


def test_replaced_equals_one_text_at_a_time(spark):
    """Rows, repeated rows, null ids and texts, long texts and clashing columns against a loop over each text."""
    texts = [
        None, "", "nothing here", "Mail ann@corp.org or bob@corp.org, then ann@corp.org again.", "Mr. John Smith called +1 (415) 555-2671. Smith left.",
        "ip 10.1.2.3 and " + "word " * 60_000 + "ann@corp.org", "token = " + "0123456789abcdef" * 2 + "!", "bob@corp.org" * 1,
    ]
    rows = [(k if k != 4 else None, t, "x", k) for k, t in enumerate(texts)] + [(3, texts[3], "x", 3)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, __spans string, __row int").repartition(4)
    got = S.replaced(docs, key=b"k", count_col="n")
    assert got.columns == ["doc_id", "text", "__spans", "__row", "n"]
    found = {t: sorted({tuple(e) for e in S.with_bare_names(t, S.find_entities(t))}) if t else [] for t in texts}
    names = spark.createDataFrame(sorted({(e[2], e[3]) for f in found.values() for e in f}), "kind string, canonical string")
    given = {(r.kind, r.canonical): r.replacement for r in S.assign(names, b"k").collect()}
    want = []
    for key, text, spans, row in rows:
        out, end = [], 0
        for start, stop, kind, canonical in found[text]:
            out += [text[end:start], S.as_shown(text[start:stop], kind, given[kind, canonical])]
            end = stop
        want.append((key, text if text is None else "".join(out) + text[end:], spans, row, len(found[text])))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(len(f) for f in found.values()) >= 8
    assert S.replaced(docs.limit(0), key=b"k").collect() == []


def test_titles_in_chains_and_capitals_and_small_words():
    assert names_in("Prof. Dr. Weber and Herr Dr. Karl Braun; Dr. who, Prof. Dr.") == ["Weber", "Karl", "Braun"]
    assert names_in("Ms. de la Cruz, Mr. van Gogh, Herr Ludwig van Beethoven") == ["Cruz", "Gogh", "Ludwig", "Beethoven"]
    assert names_in("MR. SMITH, MRS O'BRIEN and PROF. DR. ANNA WEBER-KLEIN") == ["SMITH", "O'BRIEN", "ANNA", "WEBER", "KLEIN"]
    assert names_in("MS Word, DR Congo and MR") == []
    kinds = {text: [k for _, _, k, _ in S.find_entities(text)] for text in ("Herr Dr. Karl Braun", "FRAU DR. EVA BRAUN")}
    assert [k[0] for k in kinds.values()] == ["given:latin:m", "given:latin:f"]


def test_bare_titles_are_no_names_of_the_text():
    text = "Prof. Dr. Weber met Dr. Braun. Dr said Weber."
    assert [text[a:b] for a, b, _, _ in S.with_bare_names(text, S.find_entities(text))] == ["Weber", "Braun", "Weber"]


@pytest.mark.parametrize("shown", ["+1 (415) 555-2671", "+44 20 7946 0958", "020 7946 0958", "+49 (30) 901820", "+123 4567 8"])
def test_phones_keep_country_and_grouping_on_every_draw(shown):
    canonical = S.plain_digits(shown)
    seen = set()
    for attempt in range(12):
        other = S.as_shown(shown, "phone", S.surrogate(S.KEY, "phone", canonical, attempt))
        assert re.sub(r"\d", "0", other) == re.sub(r"\d", "0", shown)
        assert other[: 2 if shown[0] == "+" else 1] == shown[: 2 if shown[0] == "+" else 1]
        if attempt < 8:
            keep = max(len(canonical) - 7, min(3, len(canonical) - 4)) if attempt else len(canonical) - 7
            assert S.plain_digits(other)[:keep] == canonical[:keep]
        seen.add(other)
    assert len(seen) > 10
