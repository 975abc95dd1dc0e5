"""Text garbled by a wrong character encoding: finding it by a table of garbled forms, and restoring it.

1. Each page's content, decoded by its declared charset, and its title are cut into tokens that have characters beyond
   ASCII.  Tokens are counted over the corpus.
2. For every distinct word of the corpus the forms are generated that it takes under all chains of encodings (written in
   one, read in another, once or twice, with replacement characters where UTF-8 is expected).  A form that is itself a
   word of the corpus, and a rarer one than its original, is garbled.  Originals come from the corpus, so that they are
   verified.  Sites count by the square roots of their pages, so that one misread site doesn't outvote the others.
3. Document tokens are joined with this table.  A text with a garbled token is a case, unless the token is quoted as an
   example.  So is one with replacement or control characters whose original the corpus doesn't have.
4. Restoring substitutes the originals; a text whose bytes can be read whole in another way is read that way.  A form
   that keeps less than half of its letters doesn't tell its original, and is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import spread, stored
from .page import declared_charset

# Names of public character encodings.  Wrong readings of UTF-8, and of one-byte encodings.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "iso-8859-2", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "iso-8859-15")
WRITTEN = ("cp1252", "cp1250", "cp1251", "koi8-r", "iso-8859-2", "iso-8859-5")
READ_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "koi8-r", "iso-8859-2", "iso-8859-5", "cp437", "cp850", "cp866", "mac-roman")
#: An original must have so many times the votes of its garbled form; a form of several bytes for one character, which
#: betrays itself, needs so much less.
COMMONER, BETRAYED = 2.0, 0.2
#: The share of a form's characters that aren't lost, from which on it tells its original.
TELLING = 0.5

_TOKEN = re.compile(r"[A-Za-z]*[^\x00-\x7f\s][A-Za-z \u0085\u0080-\U0010ffff]*")
_RUN = re.compile(r"[^\x00-\x7f]+")
_BROKEN = re.compile("[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
#: Words of display before a token and of replacement after it mark the token as a quoted example.
_QUOTED = re.compile(r"\b(?:saw|see|sees|shows?|showed|reads?|printed|displayed|became|typed|like)\s+[\"'“‘(]?(\S*[^\x00-\x7f]\S*?)[\"'”’)]?\s+(?:where|instead|in place|rather than|for the word)\b")


def sloppy(data: bytes, name: str) -> str:
    """The bytes read in an encoding; bytes that it doesn't define become the control characters of their number."""
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        return "".join(data[i : i + 1].decode(name) if _defined(data[i], name) else chr(data[i]) for i in range(len(data)))


@lru_cache(maxsize=None)
def _defined(byte: int, name: str) -> bool:
    try:
        bytes([byte]).decode(name)
        return True
    except UnicodeDecodeError:
        return False


def chains() -> list[tuple[str, str]]:
    """All (written in, read as) pairs, and for UTF-8 those that happen twice."""
    once = [("utf-8", r) for r in UTF8_READ_AS] + [(w, r) for w in WRITTEN for r in READ_AS if w != r]
    return once + [(w, "utf-8") for w in WRITTEN] + [(f"utf-8>{a}", b) for a in ("cp1252", "latin-1", "cp1251") for b in ("cp1252", "latin-1", "cp1251")]


def garble(word: str, written: str, read: str) -> str | None:
    """The word as it comes out if written in one encoding and read in the other; None if it can't be or doesn't change."""
    try:
        if ">" in written:
            word_once = sloppy(word.encode("utf-8"), written.split(">")[1])
            out = sloppy(word_once.encode("utf-8"), read)
        elif read == "utf-8":
            out = word.encode(written).decode("utf-8", "replace")
        else:
            out = sloppy(word.encode(written), read)
    except UnicodeEncodeError:
        return None
    return out if out != word else None


def garbled_forms(word: str) -> dict[str, str]:
    """Form to chain, the first chain that gives a form."""
    found: dict[str, str] = {}
    for w, r in chains():
        form = garble(word, w, r)
        if form is not None and form not in found:
            found[form] = f"{w}>{r}"
    return found


def _is_letters(word: str) -> bool:
    return sum(map(str.isalpha, word)) >= 2


def tokens_of(text: str) -> set[str]:
    """The tokens with characters beyond ASCII, and the runs of such characters inside them."""
    found: set[str] = set()
    if text.isascii():
        return found
    quoted = {m[1] for m in _QUOTED.finditer(re.sub(r"<[^>]*>", "", text))} if "where" in text or "instead" in text or "rather" in text or " place" in text else ()
    for t in _TOKEN.findall(text):
        if t not in found and t not in quoted:
            found.add(t)
            if not t[0] > "\x7f" or not t[-1] > "\x7f":
                found.update(_RUN.findall(t))
    return found


def read_declared(content: bytes, content_type: str | None) -> str:
    """The content by the charset that the content type names, UTF-8 if it names none or an unknown one."""
    try:
        return content.decode(declared_charset(content_type) or "utf-8", "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


def page_tokens(records: DataFrame) -> DataFrame:
    """(row_id, host, field, broken, tokens): for each page its content, and its title if it has one.

    ``broken`` tells whether there are replacement or control characters.  Fields all in ASCII give no row.
    """
    m = F.col("metadata")
    pages = records.where(F.col("row_id").isNotNull() & m["warc-trec-id"].isNotNull() & (F.octet_length("content") > 0))
    pages = spread(pages.select("row_id", m["content-type"].alias("type"), m["page-title"].alias("title"), F.lower(F.regexp_extract(m["warc-target-uri"], "^\\w+://([^/?#:]+)", 1)).alias("host"), "content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row_id, host, kind, title, content in zip(b["row_id"], b["host"], b["type"], b["title"], b["content"]):
                for field, text in (("content", read_declared(content, kind)), ("page-title", title)):
                    if text and (found := tokens_of(text)) or text and _BROKEN.search(text):
                        out.append((row_id, host, field, _BROKEN.search(text) is not None, list(found)))
            yield pd.DataFrame(out, columns=["row_id", "host", "field", "broken", "tokens"])

    return pages.mapInPandas(run, "row_id bigint, host string, field string, broken boolean, tokens array<string>")


def garbled_words(counts: DataFrame) -> DataFrame:
    """(token, original, chain): the tokens of (token, votes) that are a garbled form of a commoner one.

    Of several originals the one with most votes counts, of these the smallest.
    """

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for word, votes in zip(b["token"], b["votes"]):
                letters = _is_letters(word)
                for form, chain in garbled_forms(word).items():
                    if (letters or chain.startswith("utf-8")) and not form.isascii():
                        out.append((form, word, votes, chain))
            yield pd.DataFrame(out, columns=["token", "original", "original_votes", "chain"])

    table = spread(counts.where(~F.col("token").rlike("[�\u0080-\u009f]"))).mapInPandas(forms, "token string, original string, original_votes double, chain string")
    longer = F.col("chain").startswith("utf-8") & (F.length("token") > F.length("original")) | F.col("token").contains("�")
    hits = counts.join(table, "token").where(F.col("original_votes") >= F.when(longer, BETRAYED).otherwise(COMMONER) * F.col("votes"))
    # where single characters are lost the rest of the word is a pattern that its original fits
    key = lambda c: F.regexp_replace(c, "[^\\x00-\\x7f]", "�")
    kept = F.length(F.regexp_replace("key", "�", "")) >= TELLING * F.length("key")
    keyed = counts.withColumn("key", key("token")).where(kept)
    clean = keyed.where(~F.col("token").rlike("[�\u0080-\u009f]")).select("key", F.col("token").alias("original"), F.col("votes").alias("original_votes"))
    fits = F.rlike("original", F.concat(F.lit("^"), F.replace("token", F.lit("�"), F.lit(".")), F.lit("$")))
    lost = keyed.where(F.col("token").contains("�")).join(clean, "key").where(fits & (F.col("original_votes") >= BETRAYED * F.col("votes")))
    hits = hits.select("token", "original", "original_votes", "chain").union(lost.select("token", "original", "original_votes", F.lit("lost>utf-8")))
    first = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("original_votes"), "original"))
    return hits.withColumn("_r", first).where("_r = 1").select("token", "original", "chain")


def _evidence(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    pages = stored(page_tokens(records))
    by_host = pages.select("host", F.explode("tokens").alias("token")).groupBy("token", "host").agg(F.count("*").alias("n"))
    counts = stored(by_host.groupBy("token").agg(F.sum(F.sqrt("n")).alias("votes")))
    return pages, stored(garbled_words(counts))


def garbled_fields(records: DataFrame) -> DataFrame:
    """(row_id, field): ``content`` or ``page-title`` of the pages in which characters aren't those that were written.

    Text all in ASCII without control characters is never a case.  Records that are no pages give no row.
    """
    pages, table = _evidence(records)
    hit = pages.select("row_id", "field", F.explode("tokens").alias("token")).join(table.select("token"), "token", "left_semi")
    return hit.select("row_id", "field").union(pages.where("broken").select("row_id", "field")).distinct()


def restore(text: str, originals: dict[str, str]) -> str:
    """The text with its garbled tokens, else the garbled runs inside them, replaced by their originals."""

    def one(m: re.Match) -> str:
        t = m[0]
        if t in originals:
            return originals[t]
        return _RUN.sub(lambda r: originals.get(r[0], r[0]), t)

    return _TOKEN.sub(one, text)


def reread(content: bytes, text: str) -> str:
    """The text that the bytes give as UTF-8 if they are valid UTF-8 and the text isn't that already; else the text."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        if "�" in text or re.search("[\x80-\x9f]", text):
            return sloppy(content, "cp1252")
        return text


def restored_fields(records: DataFrame) -> DataFrame:
    """(row_id, field, restored, complete): the affected fields with their text as far as it can be had.

    ``complete`` is false if replacement or control characters are left.
    """
    pages, table = _evidence(records)
    broken = pages.where("broken").select("row_id", "field", F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("original"))
    lost = F.length(F.regexp_replace("token", "[^�]", ""))
    telling = table.where(lost <= (1 - TELLING) * F.length("token")).drop("chain")
    hits = pages.select("row_id", "field", F.explode("tokens").alias("token")).join(telling, "token").select("row_id", "field", "token", "original")
    found = hits.union(broken).groupBy("row_id", "field").agg(F.map_from_entries(F.collect_set(F.when(F.col("token").isNotNull(), F.struct("token", "original")))).alias("originals"))
    m = F.col("metadata")
    texts = records.select("row_id", m["content-type"].alias("type"), m["page-title"].alias("title"), "content").join(found, "row_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row_id, kind, title, content, field, originals in zip(b["row_id"], b["type"], b["title"], b["content"], b["field"], b["originals"]):
                text = reread(content, read_declared(content, kind)) if field == "content" else title
                text = restore(text, dict(originals))
                out.append((row_id, field, text, _BROKEN.search(text) is None))
            yield pd.DataFrame(out, columns=["row_id", "field", "restored", "complete"])

    return texts.mapInPandas(run, "row_id bigint, field string, restored string, complete boolean")
