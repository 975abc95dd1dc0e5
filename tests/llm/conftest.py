import pytest

SITE = "www.site{}.test"
MAIN = ["The old miller slowly repaired the broken weather vane near the river, and the bakery kept a set of brass lamps.", "A quiet neighbour measured the northern stairway before the first frost. The school orchestra sold a film about moss.", "Nobody in the village asked why the harbour office had moved the wooden footbridge behind the station."]
FURNITURE = ["Home | News | About us", "We use small files to remember your settings. By staying here you agree.", "Sign up for our letter and never miss a new article.", "All rights reserved 2019."]


def page(i, main=None, host=None, lang="en", extra=""):
    body = "\n".join(f"<p>{m}</p>" for m in (MAIN if main is None else main))
    return (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<html lang='{lang}'>\n<head><title>Page {i}</title></head>\n<body>\n<div class=\"top\">\n<div>{FURNITURE[0]}</div>\n</div>\n"
        f"<div class=\"inner\">\n<h1>Title number {i} of the page</h1>\n{body}\n{extra}\n</div>\n<div class=\"side\">\n<p>{FURNITURE[2]}</p>\n<li>Read also: story {i}…</li>\n<p>{FURNITURE[1]}</p>\n</div>\n"
        f"<div class=\"foot\">\n<p>{FURNITURE[3]}</p>\n</div>\n</body></html>"
    )


SCHEMA = "row_id bigint, path string, rec_no bigint, metadata map<string,string>, content binary, host string, text string, lines int, label string, features string"


def record(i, content, uri=None, kind="text/html; charset=utf-8", label="en", title=None, trec=True):
    m = {"warc-target-uri": uri or f"http://www.site{i % 3}.test/{i}", "content-type": kind, "content-language": label, "page-title": title}
    m = {k: v for k, v in m.items() if v is not None}
    if trec:
        m["warc-trec-id"] = f"t{i}"
    return (i, "a", i, m, content.encode() if isinstance(content, str) else content, "x", "y", 1, "z", "w")


@pytest.fixture(scope="session")
def records(spark):
    """Plain pages, keyword pages, and records that are no pages, with columns that clash with the operators' own."""
    words = "lamp kettle mirror drawer basket saddle carpet engine".split()
    rows = [record(i, page(i, [f"{m} It was day {i} of the month." for m in MAIN])) for i in range(24)]
    rows += [record(i, page(i, [" ".join(words[(i * k + j * j) % 8] for j in range(60)) for k in range(1, 4)])) for i in range(100, 112)]
    rows += [record(200, None), record(201, b""), record(202, page(202), trec=False), (203, "a", 1, None, b"x", None, None, None, None, None), (None, "a", 1, {"warc-trec-id": "q"}, b"<p>x</p>", None, None, None, None, None)]
    rows += [record(210, b"\xff\xfe<"), record(211, "<p"), record(212, "word " * 60_000), record(213, "<div>" * 3000 + "deep"), record(214, "plain text. " + "a" * 100_000)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def langrefs(spark):
    samples = {
        "en": ["The old miller repaired the weather vane near the river and the bakery kept a set of lamps.", "A quiet neighbour measured the stairway before the first frost.", "Nobody in the village asked why the office had moved the footbridge behind the station.", "It was the day of the month that the school sold a film about moss."],
        "de": ["Der alte Müller repariert die Wetterfahne nahe dem Fluss und die Bäckerei behält einen Satz Lampen.", "Eine ruhige Nachbarin misst die Treppe vor dem ersten Frost.", "Niemand im Dorf fragte, warum das Amt die Brücke hinter dem Bahnhof übermalt hat."],
        "fr": ["Le vieux meunier répare la girouette près de la rivière et la boulangerie garde un lot de lampes.", "Une voisine discrète mesure l’escalier avant les premières gelées.", "Personne dans le village ne demande pourquoi le bureau a déplacé la passerelle."],
    }
    rows = [(i, g, s) for i, (g, s) in enumerate((g, s) for g, ss in samples.items() for s in ss)] + [(98, None, "x"), (99, "en", None)]
    return spark.createDataFrame(rows, "ref_id bigint, lang string, sample string")
