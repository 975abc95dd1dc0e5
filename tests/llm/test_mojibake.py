import pytest

from arborsig.llm.mojibake import garble, garbled_fields, restore, restored_fields, tokens_of
from tests.llm.conftest import SCHEMA, record

CLEAN = "<p>Der alte Müller übermalt die Brücke – “frühe Säcke” in Köln, über NÃO PERCA société d’été żółty</p>"


def fixture():
    rows = [record(i, CLEAN + f"<p>{i}</p>", title="Müller") for i in range(8)]
    bad = {
        20: CLEAN.encode("utf-8").decode("cp1252", "replace").encode(), 21: CLEAN.replace("Müller", "MÃ¼ller").encode(), 22: CLEAN.replace("Brücke", "BrÃƒÂ¼cke").encode(), 23: CLEAN.replace("frühe Säcke", "frühe Sдcke").encode(),
        24: "Müller".encode("cp1252"), 25: "é \x93x\x94".encode(), 26: CLEAN.replace("Säcke", "S�cke").encode(),
    }
    rows += [record(i, c) for i, c in bad.items()]
    rows += [record(40, "Müller – Brücke".encode("cp1252"), kind="text/html; charset=windows-1252"), record(41, "all in ASCII", kind="text/html; charset=koi8-r"), record(42, CLEAN, kind="text/html; charset=nonsense")]
    rows += [record(43, CLEAN + "<p>Readers of the printed list saw cafÃ© where another word had been typed.</p>"), record(44, CLEAN, title="MÃ¼ller"), record(45, None), record(46, b""), record(47, "MÃ¼ller", trec=False), (48, None, None, None, b"x", None, None, None, None, None)]
    return rows, set(bad)


def test_affected_fields(spark):
    rows, bad = fixture()
    df = spark.createDataFrame(rows + [rows[8]], SCHEMA).dropDuplicates(["row_id"])
    found = {(r["row_id"], r["field"]) for r in garbled_fields(df).collect()}
    assert found == {(i, "content") for i in bad} | {(44, "page-title")}
    back = {(r["row_id"], r["field"]): r for r in restored_fields(df).collect()}
    assert set(back) == found
    for i in (21, 22, 23, 26):  # 26 has lost a character that the corpus' word has
        assert back[(i, "content")]["restored"] == CLEAN and back[(i, "content")]["complete"]
    assert back[(44, "page-title")]["restored"] == "Müller"


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert garbled_fields(none).count() == 0 and restored_fields(none).count() == 0


@pytest.mark.parametrize("word", ["Müller", "“frühe", "société", "żółty"])
def test_round_trip_of_chains(word):
    for read in ("cp1252", "latin-1", "cp1251"):
        bad = garble(word, "utf-8", read)
        assert bad != word and restore(f"a {bad}.", {bad: word}) == f"a {word}."
    assert garble("plain", "utf-8", "cp1252") is None


def test_tokens():
    assert tokens_of("plain text") == set() and "town’s" in tokens_of("the town’s x") and "’" in tokens_of("the town’s x")
    assert tokens_of("é" * 100_000) == {"é" * 100_000}
