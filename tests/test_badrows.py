import re
from datetime import datetime

import pytest

from arborsig.operators.badrows import METADATA_RULES, find_errors, load_rows

OK = "xc12-0000wb-00-00001,2019-07-02T18:34:08Z,https://a.test/x,text/html; charset=utf-8,63,200,"


def reason(line):
    """A plain reading of the format, one line at a time."""
    if line is None:
        return "columns"
    cell = r'(?:"(?:[^"]|"")*"|[^",]*)'
    if not re.fullmatch(f"{cell}(?:,{cell})*", line):
        return "quoting"
    cells = [c[1:-1].replace('""', '"') if c[:1] == '"' else c for c in re.findall(f"(?:^|,)({cell})", line)]
    if len(cells) != 7:
        return "columns"
    try:
        datetime.strptime(cells[1], "%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "value"
    return None if line.isascii() and all(re.fullmatch(r.pattern, c) for r, c in zip(METADATA_RULES, cells)) else "value"


LINES = [
    OK, None, "", ",", '"', '""', '"""', '""""', OK + ",", OK.replace("63", '"63"'), OK.replace("63", '"6"3'), OK.replace("63", '6"3'), OK.replace("html; charset=utf-8", 'html; a="b"'),
    OK.replace("text/html; charset=utf-8", '"text/html; a=""b"", c=1"'), OK.replace("07-02", "02-30"), OK.replace("18:34", "24:34"), OK.replace("34:08", "34:60"), OK.replace("200", "099"), OK.replace("200", "600"),
    OK.replace("text/html; charset=utf-8", ""), OK + "sha1:" + "A" * 32, OK + "sha1:" + "A" * 31, OK.replace("a.test", "ä.test"), OK.replace("a.test", "a test"), OK.replace("63", " 63"), OK + "\n", OK.replace("text/html", '"text/html;\n'),
    OK.replace("https://a.test/x", '"https://a.test/x,y"'), OK.replace("https://a.test/x", "https://"), OK.replace(",", ";"), OK.replace("63", ""), '"' + "a" * 200_000, '"' + '""' * 100_000 + '"', "," * 50_000, OK.replace("2019", "0000"),
]


def test_reasons_agree_with_a_plain_reading(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "line_id bigint, line string")
    got = {r["line_id"]: r["reason"] for r in find_errors(df, "line_id").collect()}
    want = {i: reason(x) for i, x in enumerate(LINES)}
    assert got == {i: r for i, r in want.items() if r}


def test_every_row_is_valid_or_an_error(spark):
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in enumerate(LINES)] + [(0, OK, "b", 2)], "line_id bigint, line string, http_status string, value int")
    valid, errors = load_rows(df, "line_id")
    rows = valid.collect()
    assert len(rows) + errors.count() == len(LINES) + 1
    r = next(r for r in rows if r["line_id"] == 0)
    assert r["http_status"] == 200 and r["_http_status"] in "ab" and r["content_length"] == 63 and r["warc_date"] == datetime(2019, 7, 2, 18, 34, 8)


@pytest.mark.parametrize("line", ["line", "text"])
def test_empty_table(spark, line):
    df = spark.createDataFrame([], f"k string, {line} string")
    valid, errors = load_rows(df, "k", line)
    assert valid.count() == errors.count() == 0
