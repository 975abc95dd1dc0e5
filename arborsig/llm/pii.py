"""Personal information in free text: found through an offset-preserving normalisation, replaced by typed placeholders.

A transducer rewrites disguises (full-width and look-alike letters, invisible characters, garbled UTF-8, spelled digits,
``(at)`` and ``dot``) and keeps for every piece of its output where it came from.  Detectors work on its output; the
spans they find are mapped back to characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import spread, stored

# Common given names of the languages in use.
GIVEN = frozenset(
    """Martin Alice Nora Oliver Ruth Judith Thomas Edwin Simon Howard Clara Margaret John James Mary Robert William Emma
    David Sarah Peter Anna Paul Michael Laura George Henry Lucy
    Dieter Jürgen Anneliese Katrin Heike Stefan Lena Matthias Uwe Sabine Hans Klaus Monika Petra Wolfgang Ursula
    Solène Gérard Élodie Jean-Luc Agnès Camille Benoît Pascal Mathilde Thierry Pierre Marie Jacques Sophie Luc Hélène
    Marta Álvaro Inés Joaquín Pilar Rodrigo Javier Tomás Carmen Lucía José Juan María Pablo Ana Elena Sofía Diego
    Rui Tiago Conceição João Leonor Beatriz Inês Duarte Manuel Teresa Sofia Pedro Luís Catarina
    Lorenzo Matteo Paolo Serena Niccolò Chiara Giulia Marco Luca Giovanni Francesca Elisa Davide Ilaria Alessandro
    Joost Sanne Pieter Willem Maarten Jeroen Femke Anouk Marijke Hendrik Daan Lotte Wouter Jan Bram Lieke
    Tomasz Małgorzata Agnieszka Paweł Katarzyna Piotr Krzysztof Zofia Marcin Ewa Stanisław Jadwiga Wojciech Halina Andrzej
    Ирина Дмитрий Виктор Наталья Павел Людмила Ольга Сергей Анна Елена Иван Мария Алексей Татьяна Николай Светлана""".split()
)
# Words that stand for digits, in the languages in use.
DIGITS = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
        "zero um dois três quatro cinco seis sete oito nove",
        "zero uno due tre quattro cinque sei sette otto nove",
        "nul een twee drie vier vijf zes zeven acht negen",
        "zero jeden dwa trzy cztery pięć sześć siedem osiem dziewięć",
        "ноль один два три четыре пять шесть семь восемь девять",
    )
    for digit, word in enumerate(words.split())
} | {"oh": "0", "zwo": "2"}
# Top-level domains accepted after a spelled "dot" in small letters.
TLDS = "test|example|invalid|localhost|com|org|net|edu|gov|info|biz|io|eu|de|fr|es|pt|it|nl|pl|ru|uk|us|at|ch|be"
# Letters of other alphabets that look like Latin ones.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһАВЕКМНОРСТУХІЈЅ", "aeopcyxijsdhABEKMHOPCTYXIJS")
WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0x3000: " ", 0xA0: " ", 0x202F: " ", 0x2007: " ", 0x2011: "-", 0x2010: "-", 0x2012: "-", 0x2212: "-"}

_INVISIBLE = "­​‌‍⁠﻿"
_GARBLED = re.compile("(?:[Â-ß][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|[à-ï][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{2})+")
_WIDE = re.compile("[" + "".join(map(chr, WIDE)).replace("\\", "\\\\").replace("]", "\\]") + "]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_BORDER = re.compile("[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")
_MIXED = re.compile(r"(?=[A-Za-z]*[Ѐ-ӿ])(?=[Ѐ-ӿ]*[A-Za-z])[A-Za-zЀ-ӿ]{2,}")
_SPELLED = re.compile(r"\b(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r")(?:[ \-]+(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + r")){5,}\b", re.I)
_AT = r"(?:\s?\(\s?(?:at|AT|arroba|a)\s?\)\s?|\s?\[\s?(?:at|AT|a)\s?\]\s?|\s?\{\s?at\s?\}\s?|\s(?:AT|arroba|chiocciola|arobase|apenstaartje|małpa|собака)\s|\s?@\s?)"
_DOT = r"(?:\s?\(\s?(?:dot|DOT|punto|punkt|point|ponto)\s?\)\s?|\s?\[\s?(?:dot|DOT)\s?\]\s?|\s(?:DOT|punto|Punkt|ponto|kropka|точка)\s|\.)"
_LOCAL, _LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9._+\-]*[A-Za-z0-9])?", r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_DISGUISED = re.compile(rf"(?<![\w.+\-])({_LOCAL})({_AT})({_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}})(?![\w])")
_DISGUISED_LOW = re.compile(rf"(?<![\w.+\-])({_LOCAL})(\sat\s)({_LABEL}(?:\sdot\s{_LABEL})*(?:\sdot\s|\.)(?:{TLDS}))(?![\w])")


#: Without one of these a text has no disguised address of the first kind.
_SIGNS = ("(at", "[at", "{at", "( at", "[ at", "{ at", "(AT", "[AT", "(a)", "[a]", " AT ", " @", "@ ", " DOT ", "(dot", "[dot", "( dot", "(DOT", "[DOT", "arroba", "chiocciola", "arobase", "apenstaartje", "małpa", "собака", "(punt", "(point", "(ponto")


class Normal:
    """A normalised text and where its characters came from."""

    __slots__ = ("text", "starts", "sources")

    def __init__(self, source: str):
        self.text, self.starts, self.sources = source, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts replacements in place of spans (sorted, apart) of the present text."""
        if not edits:
            return
        pieces, starts, sources, at, n = [], [], [], 0, 0
        for a, b, new in edits:
            self._keep(at, a, n, starts, sources)
            pieces.append(self.text[at:a])
            n += a - at
            starts.append(n)
            sources.append((self.source(a), 0))
            pieces.append(new)
            n += len(new)
            at = b
        self._keep(at, len(self.text), n, starts, sources)
        pieces.append(self.text[at:])
        self.text, self.starts, self.sources = "".join(pieces), starts, sources

    def _keep(self, a: int, b: int, n: int, starts: list, sources: list) -> None:
        if self.starts is None:
            starts.append(n)
            sources.append((a, 1))
            return
        i = bisect_right(self.starts, a) - 1
        starts.append(n)
        s, step = self.sources[i]
        sources.append((s + step * (a - self.starts[i]), step))
        for j in range(i + 1, len(self.starts)):
            if self.starts[j] >= b:
                break
            starts.append(n + self.starts[j] - a)
            sources.append(self.sources[j])

    def source(self, pos: int) -> int:
        """The position in the source of a position in the normalised text."""
        if self.starts is None:
            return pos
        i = bisect_right(self.starts, pos) - 1
        s, step = self.sources[i]
        return s + step * (pos - self.starts[i])


def _ungarbled(s: str) -> str | None:
    try:
        return b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in s).decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def normalise(source: str) -> Normal:
    out = Normal(source)
    if not source.isascii():
        if _GARBLED.search(source):
            out.rewrite([(m.start(), m.end(), new) for m in _GARBLED.finditer(source) if (new := _ungarbled(m[0])) is not None])
        if _WIDE.search(out.text):
            out.text = out.text.translate(WIDE)
        if any(c in out.text for c in _INVISIBLE):
            out.rewrite([(m.start(), m.end(), "") for m in re.finditer(f"[{_INVISIBLE}]", out.text)])
        if _CYRILLIC.search(out.text) and _BORDER.search(out.text):
            out.text = _MIXED.sub(lambda m: m[0].translate(LOOKALIKE), out.text)
    if sum(map(DIGITS.__contains__, out.text.lower().replace("-", " ").split())) >= 6:
        out.rewrite([(m.start(), m.end(), "".join(DIGITS[w.lower()] for w in re.split(r"[ \-]+", m[0]))) for m in _SPELLED.finditer(out.text)])
    low = out.text
    edits = []
    if any(x in low for x in _SIGNS):
        for m in _DISGUISED.finditer(low):
            if m[2] != "@" or not re.fullmatch(r"[A-Za-z0-9.\-]+", m[3]):
                edits.append((m.start(), m.end(), f"{m[1]}@{re.sub(_DOT, '.', m[3])}"))
    if " dot " in low:
        edits += [(m.start(), m.end(), f"{m[1]}@{m[3].replace(' dot ', '.')}") for m in _DISGUISED_LOW.finditer(low)]
    edits.sort()
    out.rewrite([e for k, e in enumerate(edits) if not k or e[0] >= edits[k - 1][1]])
    return out


_EMAIL = re.compile(rf"(?<![\w.+\-@]){_LOCAL}@{_LABEL}(?:\.{_LABEL})+")
_PHONE = re.compile(
    r"(?<![\w+.,/\-])(?:\+\d{1,3}[ .\-/]?(?:\(0?\d{1,4}\)[ .\-/]?)?\d(?:[ .\-/]?\d){5,12}"
    r"|00\d{1,3}[ .\-/](?:\(?\d{1,4}\)?[ .\-/]?)\d(?:[ .\-/]?\d){4,11}"
    r"|\(0?\d{2,4}\)[ .\-/]?\d{2,4}(?:[ .\-/]?\d{2,4}){1,3}"
    r"|0\d{1,4}[ .\-/]\d{2,5}(?:[ .\-/]\d{2,4}){1,4}"
    r"|0\d{9,10}"
    r"|(?:1[ .\-])?\d{3}([ .\-])\d{3}\1\d{4})(?![\w]|[\-/.]\d)"
)
_ID = re.compile(
    r"(?<![\w.\-/])(?:\d{8}[A-Z]|\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]\d[A-Z]\d{2}[A-Z]\d{4}|[A-Z]{2}\d{7}|[A-Z]{3}\d{6}|[1-9]\d{10}"
    r"|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{3}\.\d{3}\.\d{3}-\d{2}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])(?![\w]|[\-/]\w)"
)
# Words for identity documents; what follows them is a number of a person, whatever its shape.
_ID_CUE = re.compile(
    r"(?:(?i:identity (?:card|number)|passport (?:number|no\.?)|\bID no\.?|national insurance (?:number|no\.?)|social security (?:number|no\.?)|Ausweisnummer|Personalausweis Nr\.?|Reisepass Nr\.?|documento de identidad|bilhete de identidade(?: n\.º)?|cartão de cidadão|pièce d[’']identité(?: n°)?"
    r"|passeport n°|carta d[’']identità(?: n\.)?|codice fiscale|Identiteitsnummer|paspoortnummer|dowodu osobistego|номер паспорта|паспорт(?: №)?)|\bDNI|\bNIE|PESEL)[ :№n°º.]{1,6}((?:[A-Z]{0,3}[ \-]?\d[0-9A-Z]*)(?:[ \-](?:\d[0-9A-Z]*|[A-Z]\b))*)(?![\w])"
)
_CAP = "[A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻА-ЯЁ]"
_LOW = r"[^\W\d_]"
_CW = rf"{_CAP}{_LOW}*"
# Words for streets and how an address is written in the languages in use.
_ADDRESS = [
    re.compile(rf"(?<![\w/,.\-])(?:(?i:flat|apt\.?|unit|suite) \d+\w?, ?)?\d+[A-Za-z]?,? {_CW}(?: {_CW})? (?i:street|st|road|rd|avenue|ave|lane|ln|close|row|hill|drive|dr|court|ct|way|place|square|terrace|gardens|crescent|grove|boulevard|blvd|parade|walk|mews)\b"),
    re.compile(rf"(?<![\w\-]){_CAP}{_LOW}*(?i:str\.|straße|strasse|gasse|weg|platz|allee|laan|straat|plein|kade|gracht|singel|dijk|dreef),? \d+ ?[a-z]?\b"),
    re.compile(rf"(?<![\w/,.\-])\d+(?: ?(?:bis|ter|quater|[a-d]))?,? ?(?i:rue|avenue|av\.|boulevard|bd|quai|place|impasse|chemin|allée|cours|route|passage|square)(?: (?i:de la|de l[’']|du|des|de|d[’']))? ?{_CW}"),
    re.compile(rf"(?<![\w/])(?i:calle|c/|avda\.?|avenida|plaza|pza\.?|paseo|ronda|travesía|camino)(?: (?i:de la|de los|de las|del|de))? {_CW}(?: {_CW})?,? (?:n\.?º ?)?\d+"),
    re.compile(rf"(?<!\w)(?i:rua|r\.|avenida|av\.|travessa|tv\.|largo|praça|calçada|estrada|alameda)(?: (?i:da|do|de|das|dos))? {_CW}(?: {_CW})?,? (?:n\.?º ?)?\d+"),
    re.compile(rf"(?<!\w)(?i:via|viale|piazza|corso|vicolo|largo|piazzale|strada|p\.zza|v\.le)(?: (?i:della|dello|delle|dei|degli|del|di))? {_CW}(?: {_CW})?,? (?:n\. ?)?\d+"),
    re.compile(rf"(?<!\w)(?i:ul\.|al\.|os\.|pl\.|ulica|aleja|osiedle|plac) ?{_CW}(?: {_CW})? \d+"),
    re.compile(rf"(?<!\w)(?i:ул\.|улица|пер\.|переулок|проспект|пр-т|просп\.|пр\.|шоссе|площадь|пл\.|набережная|наб\.|бульвар|б-р) ?{_CW}(?: {_CW})?,? (?:д\. ?|дом )?\d+"),
]
_STREETY = re.compile(r"\d.{0,40}(?i:street|\bst\b|road|\brd\b|avenue|\bave\b|lane|close|row|hill|drive|court|way|place|square|terrace|garden|crescent|grove|boulevard|blvd|parade|walk|mews|rue|quai|impasse|chemin|allée|cours|route|\bbd\b|\bav\.)|(?i:str\.|straße|strasse|gasse|weg|platz|allee|laan|straat|plein|kade|gracht|singel|dijk|dreef|calle|c/|avda|avenida|plaza|paseo|rua |r\. |travessa|largo|praça|estrada|via |viale|piazza|corso|vicolo|ul\.|al\.|os\.|pl\.|ул\.|улица|пер\.|переул|просп|пр-т|шоссе|площадь|наб)")
#: How long an address goes on after its house number: flat, town, post code.
_FLAT, _CODE = r"(?:,? (?i:(?:apt\.?|flat|кв\.|m\.) ?\d+\w?)| ?[a-z]?/\d+| bajo|,? \d\.º [A-Z])", rf"(?:[A-Z]{{2}} ?\d{{5}}|[A-Z]{{2}}\d+ \d[A-Z]{{2}}|\d{{2,5}}(?:-\d{{3}})?(?: [A-Z]{{2}})?(?= {_CAP}))"
_TAIL = re.compile(rf"{_FLAT}?(?:,? {_CODE}(?: {_CW})?|, {_CW}(?:,? {_CODE})?)?")
_DIGIT = re.compile(r"\d")
#: What any phone or identity number has.
_FIGURES = re.compile(r"(?:\d[ ().\-/]{0,2}){6}|[A-Z]\d|\d[A-Z]|[A-Z]{2} ?\d")


def numbered_lines(t: str) -> Iterator[tuple[int, int]]:
    """The lines with digits, on one of which numbers and addresses stand."""
    end = 0
    while (m := _DIGIT.search(t, end)) is not None:
        end = t.find("\n", m.end())
        end = len(t) if end < 0 else end
        yield t.rfind("\n", 0, m.start()) + 1, end


_CAPS = re.compile(rf"(?<![\w'’]){_CAP}{_LOW}+(?:-{_CAP}{_LOW}+)?(?!\w)")
_SURNAME = rf"{_CAP}{_LOW}+(?:-{_CAP}{_LOW}+)?"
_NEXT = re.compile(rf" (?:({_CAP}\.)|({_SURNAME}))(?!\w)")
_INITIAL = re.compile(rf"(?<![\w.&\-]){_CAP}\.(?: ?{_CAP}\.)? ({_SURNAME})(?!\w)")
_BEFORE = re.compile(rf"(?<![\w\-])({_SURNAME}), $")
_SURNAME_INITIAL = re.compile(rf"(?<![\w\-])({_SURNAME}), ({_CAP}\.)(?!\w)")
# Endings of surnames, for names with nothing but an initial before them; titles, which aren't part of a name.
_ENDING = re.compile(r"(?:ham|ton|son|worth|ley|meier|mann|hoff|eau|ier|ault|ez|eras|ado|ães|eira|inho|ini|etti|elli|ink|ema|stra|ski|ska|cki|cka|czyk|wicz|aro|oni|ucci|ova|ов|ова|ев|ева|ин|ина|ский|ская|ской|енко|man|berg|sen|er)$", re.I)
TITLES = frozenset("mr mrs ms miss dr prof herr frau madame monsieur mme señor señora sr sra signor signora senhor senhora dona mevrouw meneer mijnheer pan pani господин госпожа г-н г-жа".split())
NO_SURNAME = frozenset("street st road rd avenue lane close row hill ltd gmbh inc co company straße".split())


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


_GIVEN = frozenset(_plain(g) for g in GIVEN)
_given_seen: dict[str, bool] = {}


def is_given(word: str) -> bool:
    k = _given_seen.get(word)
    if k is None:
        if len(_given_seen) > 200_000:
            _given_seen.clear()
        k = _given_seen[word] = (p := _plain(word)) in _GIVEN or p in _gathered
    return k


_gathered: frozenset[str] = frozenset()


def know(names: list[str]) -> None:
    """Takes these as given names too, in this process, in place of those it was given before."""
    global _gathered
    fresh = frozenset(map(_plain, names))
    if fresh != _gathered:
        _gathered = fresh
        _given_seen.clear()


#: A title, then given names or initials and a surname; titles are evidence of a name, whatever names are known.
_TITLE = rf"(?<![\w.])(?i:{'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})\.? "
_TITLED = re.compile(rf"{_TITLE}((?:{_SURNAME}|{_CAP}\.)(?: (?:{_SURNAME}|{_CAP}\.))? {_SURNAME})(?!\w)")
#: The same for gathering given names over all texts: how many texts a word must follow titles in as a given name, with
#: how many different surnames, and how many of the commonest such words are taken.
GATHER_TEXTS, GATHER_SURNAMES, GATHERED = 3, 3, 100_000


def gathered_names(texts: DataFrame, text: str) -> list[str]:
    """Given names that stand between titles and surnames in several texts, as the corpus has them beside the list.

    Titles are followed by surnames alone as well, in some languages before other capitals; so a word counts only if
    it doesn't itself stand as a surname, behind other given names, as often.
    """
    titles = "|".join(sorted({x for t in TITLES for x in (t, t.capitalize(), t.upper())}, key=len, reverse=True))
    word = r"\p{Lu}\p{Ll}[\p{L}’'-]*"
    found = texts.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\d.])(?:{titles})\.? ({word} {word})(?![\p{{L}}])"), F.lit(1)))).alias("pair"))
    parts = F.split("pair", " ")
    pairs = stored(found.groupBy("pair").count().select(parts[0].alias("given"), parts[1].alias("surname"), "count"))
    given = pairs.groupBy(F.col("given").alias("word")).agg(F.sum("count").alias("n"), F.count("*").alias("surnames"))
    last = pairs.groupBy(F.col("surname").alias("word")).agg(F.sum("count").alias("behind"))
    kept = given.where((F.col("n") >= GATHER_TEXTS) & (F.col("surnames") >= GATHER_SURNAMES)).join(last, "word", "left").where(F.col("n") > F.coalesce("behind", F.lit(0)))
    return sorted(r["word"] for r in kept.orderBy(F.desc("n"), "word").limit(GATHERED).select("word").collect() if r["word"].lower() not in TITLES | NO_SURNAME)


def _names(t: str) -> Iterator[tuple[int, int]]:
    for m in _TITLED.finditer(t):
        last = m[1].rpartition(" ")[2].lower()
        if last not in NO_SURNAME and not any(w.rstrip(".").lower() in TITLES for w in m[1].split()):
            yield m.span(1)
    done = 0
    for m in _CAPS.finditer(t):
        if m.start() < done or not is_given(m[0]):
            continue
        a, b = m.start(), m.end()
        before = _BEFORE.search(t, max(0, a - 60), a)
        if before and (not _ENDING.search(before[1]) or before[1].lower() in TITLES or is_given(before[1])):
            before = None
        # more given names or initials, then the surname
        end = pos = b
        last = ""
        while (w := _NEXT.match(t, pos)) is not None:
            if w[2]:
                if w[2].lower() in NO_SURNAME or w[2].lower() in TITLES:
                    break
                end, last = w.end(), w[2]
            pos = w.end()
            if w[2] and not is_given(w[2]):
                break
        if before and not (last and _ENDING.search(last)):
            initial = _NEXT.match(t, b)
            yield before.start(1), initial.end() if initial and initial[1] else b
            done = b
        elif end > b:
            yield a, end
            done = end
    for m in _INITIAL.finditer(t):
        if _ENDING.search(m[1]) and m[1].lower() not in NO_SURNAME:
            yield m.start(), m.end()
    for m in _SURNAME_INITIAL.finditer(t):
        if _ENDING.search(m[1]) and not is_given(m[1]):
            yield m.start(), m.end()


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the mentions in a text, in characters of the text, sorted and without overlap."""
    norm = normalise(text)
    t = norm.text
    found: list[tuple[int, int, str, int]] = []  # the last is the rank: the lower wins where spans overlap
    if "@" in t:
        found += [(m.start(), m.end(), "email", 0) for m in _EMAIL.finditer(t)]
    for lo, hi in numbered_lines(t):
        if _STREETY.search(t, lo, hi):
            for p in _ADDRESS:
                for m in p.finditer(t, lo, hi):
                    tail = _TAIL.match(t, m.end())
                    found.append((m.start(), tail.end() if tail else m.end(), "address", 1))
        if _FIGURES.search(t, lo, hi):
            for m in _ID_CUE.finditer(t, lo, hi):
                found.append((m.start(1), m.end(1), "id_number", 2))
            for m in _ID.finditer(t, lo, hi):
                found.append((m.start(), m.end(), "id_number", 3))
            for m in _PHONE.finditer(t, lo, hi):
                if sum(map(str.isdigit, m[0])) >= 9:
                    found.append((m.start(), m.end(), "phone", 4))
    found += [(a, b, "name", 5) for a, b in _names(t)]
    found.sort(key=lambda x: (x[3], x[0], -x[1]))
    starts: list[int] = []  # of the spans kept, which are apart, in order
    kept: dict[int, tuple[int, str]] = {}
    for a, b, kind, _ in found:
        i = bisect_right(starts, a)
        if (not i or kept[starts[i - 1]][0] <= a) and (i == len(starts) or starts[i] >= b):
            starts.insert(i, a)
            kept[a] = (b, kind)
    return [(norm.source(a), norm.source(kept[a][0]), kept[a][1]) for a in starts]


#: What stands in a mention's place.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_personal(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, length, kind): each mention of personal information in the texts.

    ``pos`` is the number of characters before it.  Null and empty texts have no mentions; repeated rows are searched
    each by itself.
    """
    rows = spread(df.select(key, text))
    kind = rows.schema[key].dataType.simpleString()
    names = df.sparkSession.sparkContext.broadcast(gathered_names(df, text))  # at most GATHERED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        know(names.value)
        for b in batches:
            out = [(k, s, e - s, what) for k, t in zip(b[key], b[text]) if t for s, e, what in find_spans(t)]
            yield pd.DataFrame(out, columns=[key, "pos", "length", "kind"])

    return rows.mapInPandas(run, f"`{key}` {kind}, pos bigint, length int, kind string")


def redact_personal(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): the texts with typed placeholders in place of the mentions; null texts stay null."""
    rows = spread(df.select(key, text))
    kind = rows.schema[key].dataType.simpleString()
    names = df.sparkSession.sparkContext.broadcast(gathered_names(df, text))  # at most GATHERED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        know(names.value)
        for b in batches:
            yield pd.DataFrame({key: b[key], text: [redact(t, find_spans(t)) if t else t for t in b[text]]})

    return rows.mapInPandas(run, f"`{key}` {kind}, `{text}` string")
