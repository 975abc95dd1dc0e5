import pytest

from arborsig.llm.language import doubtful_labels, language_segments, main_languages, whole_sentences
from arborsig.llm.mainbody import _WORD, Vocabulary, fingerprint, hashed, is_menu, judge_pages, words_of
from arborsig.llm.page import declared_charset, parse, readable
from arborsig.llm.spam import spam_pages
from tests.llm.conftest import MAIN, page, record


@pytest.fixture(scope="module")
def judged(records, langrefs):
    from arborsig.session import durable

    return durable(judge_pages(records, langrefs, with_text=True))


def test_main_lines_are_the_article(judged):
    rows = {r["row_id"]: r for r in judged.collect()}
    first = page(3, [f"{m} It was day 3 of the month." for m in MAIN]).split("\n")
    want = [n for n, x in enumerate(first, 1) if x.startswith(("<h1>", "<p>The old", "<p>A quiet", "<p>Nobody"))]
    assert list(rows[3]["lines"]) == want
    assert set(range(24)) < set(rows) and not {200, 201, 202, 203, None} & set(rows)
    assert {210, 211, 212, 213, 214} <= set(rows) and list(rows[211]["lines"]) == []


def test_keyword_pages_are_found(judged):
    assert set(range(100, 112)) <= {r["row_id"] for r in spam_pages(judged).collect()}
    assert not set(range(24)) & {r["row_id"] for r in spam_pages(judged).collect()}


def test_languages(spark, records, langrefs):
    de = ["Der alte Müller repariert die Wetterfahne nahe dem Fluss. Eine ruhige Nachbarin misst die Treppe vor dem ersten Frost."]
    rows = [record(300, page(300, de + MAIN), label="en"), record(301, page(301, de), label="en"), record(302, page(302, de), label="DE_at"), record(303, page(303, MAIN), label=None), record(304, page(304, MAIN + ["Eine ruhige Nachbarin misst die Treppe."]), label="en-GB")]
    both = records.where("row_id < 24").union(spark.createDataFrame(rows, records.schema))
    found = sorted((r["row_id"], r["lang"]) for r in doubtful_labels(main_languages(both, langrefs, spam_pages)).collect())
    assert found == [(300, "de"), (300, "en"), (301, "de"), (303, "en")]


def test_every_page_has_a_language(spark, records, langrefs):
    from arborsig.session import durable

    wrong = [record(305, page(305, ["lamp kettle mirror drawer " * 15]), label="de"), record(306, page(306, []), uri="http://nothing.test/1", label="fr-CA")]
    pages = durable(main_languages(records.where("row_id < 204").union(spark.createDataFrame(wrong, records.schema)), langrefs, spam_pages))
    shown = {r["row_id"]: r for r in language_segments(pages).collect()}
    assert set(shown) == {*range(24), *range(100, 112), 305, 306}  # keyword pages and one without text among them
    assert all(r["page_lang"] and 0 < r["page_confidence"] <= 1 for r in shown.values()) and shown[306]["lang"] is None
    assert {r["row_id"] for r in pages.where("body").collect()} == set(range(24))
    assert doubtful_labels(pages).count() == 0


def test_empty_tables(spark, records, langrefs):
    none = records.limit(0)
    judged = judge_pages(none, langrefs)
    assert judged.count() == 0 and spam_pages(judged).count() == 0
    assert main_languages(none, langrefs, spam_pages).count() == 0
    assert main_languages(records.where("row_id < 3"), langrefs.limit(0), spam_pages).count() == 0
    assert spam_pages(judge_pages(records.where("row_id < 3"), langrefs.limit(0))).count() >= 0


def test_copies_of_an_article_keep_their_lines(spark, records, langrefs):
    notes = "".join(f"\n<li>{x}</li>" for x in ("The lamps were counted twice by the miller.", "The moss film was shown in the school."))
    many = [record(400 + i, page(77, extra=f"<ul id='notes77'>{notes}\n</ul>").replace("Sign up", f"Mirror {'abc'[i % 3]}: sign up"), uri=f"http://www.mirror{i % 3}.test/a") for i in range(18)]
    judged = judge_pages(records.union(spark.createDataFrame(many, records.schema)), langrefs).where("row_id >= 400").collect()
    text = many[0][4].decode().split("\n")
    want = {n for n, x in enumerate(text, 1) if x.startswith(("<h1>", "<p>The old", "<p>A quiet", "<p>Nobody", "<li>The"))}
    assert len(judged) == 18 and all(set(r["lines"]) == want for r in judged)


def test_broken_markup():
    p = parse("</header><td>one\n<td>two<hr>three<p>four<hr><a href=x>five</a><br>six<div style='display:none'>seven</div><!-- eight --><script>nine</script>")
    assert [u.text for u in p.units] == ["one", "two", "three", "four", "five", "six", "seven"]
    assert [u.lines for u in p.units][:3] == [[1], [2], [2]] and p.units[6].hidden and p.units[4].linked == 4
    assert parse("").units == [] and parse("HTTP/1.1 200").units == []
    assert [u.lines for u in parse("<p>a\nb\n\nc</p>").units] == [[1, 2, 4]]


def test_helpers():
    assert declared_charset('text/html; Charset="UTF-8"') == "utf-8" and declared_charset(None) is None
    assert readable("Привет, мир".encode("koi8-r") * 5, None).startswith("Привет") and readable("a naïve reading".encode("cp1252"), "windows-1252") == "a naïve reading"
    assert is_menu("Home | News") and not is_menu("He said | and then the long story of the evening went on until the lamp was out again")
    assert fingerprint("You like 12 stories", "") == fingerprint("you like 345 stories", "") and fingerprint("Related: a", "") == fingerprint("Related: b", "")
    assert len(whole_sentences("One two three. “Four five six!” Seven eight nine\nTen eleven twelve? no end")) == 3


def test_words_are_the_runs_of_letters_and_have_numbers():
    every = "".join(f"a{chr(c)}B " for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    assert words_of(every) == _WORD.findall(every) and all(words_of(f"x{chr(c)}Yz1w") == _WORD.findall(f"x{chr(c)}Yz1w") for c in range(256))
    v = Vocabulary(frozenset([hashed("the")]))
    the, low, ox = v.numbers(["The", "the", "Oxen"])
    assert v.lows[the] == v.lows[low] == low != the and v.known({the, low, ox}) == 2 and v.hashes[the] == hashed("the")
    assert sum(map(v.shapes.__getitem__, [the, low, ox])) == 2 + (2 << 32) and not v.bounded()


def test_a_site_s_result_does_not_depend_on_other_sites(spark, langrefs):
    from tests.llm.conftest import SCHEMA

    own = [record(i, page(i, [f"{m} It was day {i} of the month." for m in MAIN]), uri=f"http://alone.test/{i}") for i in range(6)]
    others = [record(1000 + 20 * s + i, page(i, [f"{m} Site {s} asked on day {i}." for m in MAIN[::-1]]), uri=f"http://site{s}.test/{i}") for s in range(40) for i in range(8)]

    def lines(rows):
        judged = judge_pages(spark.createDataFrame(rows, SCHEMA), langrefs)
        return {r["row_id"]: list(r["lines"]) for r in judged.where("row_id < 1000").collect()}

    few, many = lines(own + others[:8]), lines(own + others)
    assert few == many and len(few) == 6 and all(few.values())


def test_copies_of_an_article_do_not_make_it_furniture(spark, langrefs):
    from tests.llm.conftest import SCHEMA

    rows = [record(i, page(7, MAIN, extra="<ul><li>First brass lamp of the set</li><li>Second brass lamp of the set</li></ul>"), uri=f"http://copies{i % 3}.test/{i}") for i in range(40)]
    rows += [record(100 + i, page(i, [f"{m} It was day {i} of the month." for m in MAIN]), uri=f"http://site{i % 4}.test/{i}") for i in range(20)]
    judged = {r["row_id"]: len(r["lines"]) for r in judge_pages(spark.createDataFrame(rows, SCHEMA), langrefs).collect()}
    assert len({judged[i] for i in range(40)}) == 1 and judged[0] >= 4


def test_words_are_cut_once_for_all_that_is_said_of_a_page(spark, records, langrefs, monkeypatch):
    passes, real = [], type(records).mapInPandas
    monkeypatch.setattr(type(records), "mapInPandas", lambda df, *a, **k: passes.append(1) or real(df, *a, **k))
    assert main_languages(records.where("row_id < 24"), langrefs, spam_pages, every=False).count() == 24
    assert len(passes) == 3  # pages are parsed, judged along with their sentences, and fused


def test_a_cut_is_as_texts_are_one_by_one():
    from arborsig.llm.language import Model, Reader
    from arborsig.llm.mainbody import READ, _STOP, Unit, cut_pages, distinct_pairs, features

    texts = ["One two three. “Four five six!” Seven eight nine", "Ten eleven twelve? No end", "Der Größte fällt… Müller’s Haus.” Ой, мир труд май!", "See www.one-two.test/a now. It is there.", "Odd \ud800 half \ud801 pairs stay.", "x", "¿Qué? ¡No! 1 2 3"]
    pages = [[Unit(0, "p", t, [1], 0, False, 0) for t in own] for own in (texts, [], texts[1:2], ["lamp kettle mirror"], texts[::-1])]
    v = Vocabulary(frozenset(map(hashed, ["one", "two", "three"])))
    c = cut_pages(pages, v)
    names = list(v)
    got = [[] for _ in c.holder]
    for k, w in zip(c.stretch.tolist(), c.words.tolist()):
        got[k].append(names[w])
    assert got == [words_of(s.replace("\ud800", " ").replace("\ud801", " ")) for t in c.texts for s in _STOP.split(t)]
    assert [t for t, use in zip(c.texts, c.use) if use & READ] == [u.text for p in pages for u in p]
    groups, words = distinct_pairs(c.stretch, c.words)
    assert list(zip(groups.tolist(), words.tolist())) == sorted({*zip(c.stretch.tolist(), c.words.tolist())})
    few = features(c, [len(p) for p in pages], v)
    assert [round(2.718281828459045 ** f[0]) - 1 for f in few] == [sum(len(words_of(u.text)) for u in p) for p in pages] and few[0] == few[4]
    model = Model([("en", "One two three. It is there."), ("de", "Der Größte fällt in Haus.")])
    read = Reader(model, v)(c)
    for p, total, each, tops in zip(pages, read["total"], read["each"], read["tops"]):
        sentences = whole_sentences("\n".join(u.text for u in p))
        rows = [sum(map(model.row, s)) for s in sentences]
        assert len(tops) == len(sentences) and list(each) == pytest.approx([x for r in rows for x in r])
        assert list(total) == pytest.approx(list(sum(rows) if rows else sum(map(model.row, [w for u in p for w in words_of(u.text)]), model.row("X"))))
    assert list(read["said"]) == [True, False, True, True, True]


def test_large_pages_are_not_held_together():
    import pandas as pd

    from arborsig.llm.mainbody import TOGETHER, TOGETHER_BYTES, in_parts

    sizes = [1] * (2 * TOGETHER + 1) + [TOGETHER_BYTES // 2] * 5 + [2 * TOGETHER_BYTES, 1]
    parts = list(in_parts(iter([pd.DataFrame({"n": range(len(sizes)), "x": [b"a" * n for n in sizes]}), pd.DataFrame({"n": [], "x": []})]), "x"))
    assert [n for p in parts for n in p["n"]] == list(range(len(sizes)))
    assert all(len(p) <= TOGETHER and (len(p) == 1 or sum(map(len, p["x"])) <= TOGETHER_BYTES) for p in parts)
