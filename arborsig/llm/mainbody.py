"""Main body of web pages by tree scoring, with corpus statistics on containers and repeated lines.

1. Each page is parsed once into units and containers; the result is kept in the shared folder.
2. Paragraphs pass points for length and commas to their ancestors, discounted by link density.  The mean share of a
   page's points that containers with a given tag get is that tag's weight: on the page's host, drawn towards the mean
   over all hosts.  Likewise the words of sentences are gathered: words in stretches of text that the sample sentences'
   words already mark as sentences.
3. Lines (numbers, the site's name and what follows a short lead-in left out) that recur on a host's distinct pages, or
   on those of several hosts and on a good part of their pages, are furniture if they stand mostly in containers with
   a small share of the points: notices, teasers, menus.  Copies of an article count as one page.
4. On each page the container with the most points, discounted by its links and furniture and weighed by its tag, is
   kept, with siblings that come near it; furniture inside is left out.

Statistics are taken over all pages.  What is said of lines and tags is said host by host, relative to the host's own
pages, so a site's result doesn't depend on how many others there are.  It reaches the pages in a row a host, whose size
is bounded by the shares below, through a join that is a broadcast only if the rows are small.
"""

from __future__ import annotations

import marshal
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from ..session import spread, stored
from .page import HEADINGS, Node, Page, Unit, declared_charset, parse, readable

#: A line recurs on a host if it is on this share of the host's distinct pages, and on at least so many.
LINE_SHARE, LINE_PAGES = 0.01, 4
#: It recurs beyond a host if it is on so many distinct pages of so many hosts, and on this share of those hosts' pages.
WIDE_PAGES, WIDE_HOSTS, WIDE_SHARE = 8, 2, 0.02
#: A recurring line is furniture if its containers' mean share of their pages' points is below this.
FURNITURE_WEIGHT = 0.4
#: A tag has a weight of its own if it is on this share of the host's pages, else DEFAULT_WEIGHT.
TAG_SHARE, DEFAULT_WEIGHT = 0.005, 0.25
#: How many pages the wider level's weight of a tag counts as.
TAG_PRIOR = 4.0
#: The vocabulary of sentences: the words in marked sentences on at least so many pages, and on this share of all pages
#: with the word; of these the ones on most pages, up to a number that bounds what is broadcast.
WORD_PAGES, WORD_INSIDE, VOCABULARY = 4, 0.35, 500_000
#: Characters up to which a unit's mass grows, so that a single long one doesn't decide where the body is.
UNIT_MASS = 2000
#: A menu is shorter than this.
MENU_CHARS = 400
#: A sibling of the best container is kept as well from this part of its score on.
SIBLING = 0.6
#: The part of a container's points that its parent gets.
PASSED = 0.5

_SIGN = 1 << 63
_DIGITS = re.compile(r"\d+")
_LEAD = re.compile(r"^(\D{2,28}?)\s?:\s")
_NAV = re.compile(r"\s[|»›>·•]\s")
_BARS = re.compile("[|»›>·•]")
_WORD = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ʯͰ-῿Ⰰ-\u2fff\u3040-\ud7ff]+")
_HOST = re.compile(r"^\w+://([^/?#:]+)")
_GARBLED = re.compile("[ÃÂâÐÑРСÅÄ][\x80-\xbf‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ°]|[\x80-\x9f�]")
_ADDRESS = re.compile(r"\b(?:https?://|www\.)\S+")
_ROWS = re.compile("[|;#]")
_STOP = re.compile(r"[.!?…][\"”»“'’)\]]*\s+")

#: So many pages' words are cut and counted together at most, and of pages of so many bytes in all, unless a page alone has more.
TOGETHER, TOGETHER_BYTES = 1000, 4_000_000
#: What stands between texts and between stretches of text while words are cut, and stands for these characters in a text.
_TEXT, _STRETCH, _NEITHER = "\ud800", "\ud801", "\ue000"
#: By character: whether it is a letter as in ``_WORD``, or stands between texts or stretches.
_LETTERS = np.zeros(0x110000, dtype=bool)
for _first, _last in ("AZ", "az", "ªª", "µµ", "ºº", "ÀÖ", "Øö", "øʯ", "Ͱ῿", "Ⰰ\u2fff", "\u3040\ud7ff", (_TEXT, _STRETCH)):
    _LETTERS[ord(_first) : ord(_last) + 1] = True


#: Bytes of ASCII text other than letters to blanks.
_BLANKS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    """The runs of letters of a text; plain ASCII is cut without a regular expression."""
    return text.encode("ascii").translate(_BLANKS).decode("ascii").split() if text.isascii() else _WORD.findall(text)


def host_of(uri: str | None) -> str:
    m = _HOST.match(uri or "")
    return m[1].lower() if m else ""


def hashed(text: str) -> int:
    """A signed 64-bit hash that is the same everywhere."""
    return (xxh3_64_intdigest(text.encode("utf-8", "replace")) ^ _SIGN) - _SIGN


def fingerprint(text: str, host: str) -> int:
    """What a line and others made from the same template have in common, as a number."""
    t = text.lower()
    if host:
        t = t.replace(host, "\x01")
    m = _LEAD.match(t) if t.find(":", 2, 30) > 0 else None
    return hashed(m[1] if m else _DIGITS.sub("0", t))


def has_bars(text: str) -> bool:
    """True for text with a separator of menus between white space."""
    return _BARS.search(text) is not None and _NAV.search(text) is not None


def is_menu(text: str) -> bool:
    """True for short pieces between separators: menus and paths."""
    if not has_bars(text):
        return False
    pieces = _NAV.split(text)
    return sum(len(p.split()) <= 4 for p in pieces) * 2 > len(pieces) and len(text) < MENU_CHARS


def unit_points(text: str, linked: int, hidden: bool) -> float:
    """A paragraph's points; 0 for hidden and short text and for menus."""
    n = len(text)
    if hidden or n < 25 or has_bars(text):
        return 0.0
    return (1 + text.count(",") + min(n / 100, 3.0)) * max(0.0, 1 - linked / n)


def container_of(page: Page, node: int) -> int:
    """The container of a unit: the parent of an element that holds just the unit, else the element itself."""
    n = page.nodes[node]
    return n.parent if n.units == 1 and n.children == 0 and n.parent > 0 else node


def subtree_sums(page: Page, values: list[float], passed: float = 1.0) -> list[float]:
    """For each container the sum over the units below it, of which each further ancestor gets the part ``passed``."""
    nodes, total = page.nodes, [0.0] * len(page.nodes)
    for u, v in zip(page.units, values):
        total[u.node] += v
    for i in range(len(total) - 1, 0, -1):  # parents come before their children
        n = nodes[i]
        total[n.parent] += total[i] if n.units == 1 and n.children == 0 else passed * total[i]
    return total


def body_hash(page: Page, points: list[float], host: str) -> int:
    """The same number for copies of an article, also within other furniture: of the text of the container with the most points and of first headings."""
    best = max(range(len(points)), key=points.__getitem__) if page.units and max(points) > 0 else 0
    inside = [i == best for i in range(len(page.nodes))]
    for i in range(best + 1, len(inside)):
        inside[i] = inside[page.nodes[i].parent]
    own = [u.text for u in page.units if inside[u.node] or u.tag == "h1"]
    text = "\n".join(own)
    return hashed(text.replace(host, "\x01") if host else text)


def parse_pages(records: DataFrame, samples: frozenset[int] = frozenset()) -> DataFrame:
    """(row_id, host, label, body, fps, fshares, sigs, shares, words, blob): the parsed pages among ``records``.

    A page is a record whose metadata has ``warc-trec-id`` and whose content isn't null or empty; others give no row.
    ``body`` is the same for copies of an article; ``fps`` and ``fshares`` have a unit's fingerprint and its container's
    share of the page's points, ``sigs`` and ``shares`` a container's tag and its share, ``words`` the hashes of the
    words of sentences, as marked by the words ``samples``, and ``others`` those of words elsewhere.
    """
    m = F.col("metadata")
    pages = records.where(F.col("row_id").isNotNull() & m["warc-trec-id"].isNotNull() & (F.octet_length("content") > 0))
    pages = spread(pages.select("row_id", m["warc-target-uri"].alias("uri"), m["content-type"].alias("type"), m["content-language"].alias("label"), "content"))
    names = ["row_id", "host", "label", "body", "fps", "fshares", "sigs", "shares", "words", "others", "blob"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(samples)
        for b in in_parts(batches, "content"):
            out, parsed = [], []
            for row_id, uri, kind, label, content in zip(b["row_id"], b["uri"], b["type"], b["label"], b["content"]):
                host = host_of(uri)
                p = parse(readable(content, declared_charset(kind)))
                each = [unit_points(u.text, u.linked, u.hidden) for u in p.units]
                points = subtree_sums(p, each, PASSED)
                fp = [fingerprint(u.text, host) for u in p.units]
                total = sum(each) or 1.0
                held = [container_of(p, u.node) for u in p.units]
                own = {f: points[h] / total if h else 0.0 for f, h in zip(fp, held)}
                nodes = {n.sig: points[i] / total for i, n in enumerate(p.nodes) if i and (points[i] > 0 or n.children or n.units > 1)}
                menu = [is_menu(u.text) for u in p.units]
                blob = marshal.dumps(([(u.node, u.tag, u.text, u.lines, u.linked, u.hidden, u.links) for u in p.units], [(n.name, n.sig, n.parent, n.units, n.children) for n in p.nodes], fp, each, menu, p.lang))
                out.append((row_id, host, label, body_hash(p, points, host), list(own), list(own.values()), list(nodes), list(nodes.values()), blob))
                parsed.append(p)
            done = pd.DataFrame(out, columns=[n for n in names if n not in ("words", "others")])
            done["words"], done["others"] = marked_words(parsed, vocabulary)
            yield done[names]

    return pages.mapInPandas(run, "row_id bigint, host string, label string, body bigint, fps array<bigint>, fshares array<float>, sigs array<bigint>, shares array<float>, words array<bigint>, others array<bigint>, blob binary")


def host_statistics(parsed: DataFrame) -> DataFrame:
    """(host, known, sigs, weights): a row a host with the fingerprints of its furniture and the weights of its tags.

    Each host's pages count by their distinct bodies.  Lines, tags and pages are only ever grouped by hashes with partial
    sums, so no host or line gathers in one task.
    """
    kept = parsed.groupBy("host", "body").agg(F.min("row_id").alias("row_id"))
    firsts = kept.groupBy("body").agg(F.min("row_id").alias("first"))
    kept = stored(kept.join(firsts, "body").select("row_id", "host", (F.col("row_id") == F.col("first")).cast("int").alias("first")))
    pages = stored(kept.groupBy("host").agg(F.count("*").alias("pages")))
    distinct = parsed.select("row_id", "host", "fps", "fshares", "sigs", "shares").join(kept.select("row_id", "first"), "row_id")

    # lines on a few pages only can't recur: they are left out before hosts are told apart
    often = stored(parsed.select(F.explode("fps").alias("fp")).groupBy("fp").count().where(F.col("count") >= LINE_PAGES).select("fp"))
    lines = distinct.select("host", "first", F.inline(F.arrays_zip("fps", "fshares"))).withColumnRenamed("fps", "fp").join(often, "fp", "left_semi")
    lines = stored(lines.groupBy("fp", "host").agg(F.count("*").alias("n"), F.sum("first").alias("f"), F.sum("fshares").alias("w")).join(pages, "host"))
    wide = lines.groupBy("fp").agg(F.sum("f").alias("f_all"), F.count("*").alias("hosts"), (F.sum("w") / F.sum("n")).alias("w_all"), (F.sum("n") / F.sum("pages")).alias("share"))
    here = (F.col("n") >= LINE_PAGES) & (F.col("n") >= LINE_SHARE * F.col("pages")) & (F.col("w") < FURNITURE_WEIGHT * F.col("n"))
    there = (F.col("f_all") >= WIDE_PAGES) & (F.col("hosts") >= WIDE_HOSTS) & (F.col("share") >= WIDE_SHARE) & (F.col("w_all") < FURNITURE_WEIGHT)
    known = lines.join(wide, "fp").where(here | there).groupBy("host").agg(F.collect_list("fp").alias("known"))

    tags = distinct.select("host", F.inline(F.arrays_zip("sigs", "shares"))).withColumnRenamed("sigs", "sig").groupBy("sig", "host").agg(F.count("*").alias("n"), F.sum("shares").alias("s"))
    tags = stored(tags.join(pages, "host").where(F.col("n") >= TAG_SHARE * F.col("pages")).drop("pages"))
    every = tags.groupBy("sig").agg(((F.sum("s") + TAG_PRIOR * DEFAULT_WEIGHT) / (F.sum("n") + TAG_PRIOR)).alias("wide"))
    weight = ((F.col("s") + TAG_PRIOR * F.col("wide")) / (F.col("n") + TAG_PRIOR)).cast("float").alias("weight")
    weights = tags.join(every, "sig").select("host", F.struct("sig", weight).alias("t")).groupBy("host").agg(F.collect_list("t").alias("t"))
    rows = weights.join(known, "host", "full_outer")
    return stored(rows.select("host", F.coalesce("known", F.array().cast("array<bigint>")).alias("known"), F.col("t.sig").alias("sigs"), F.col("t.weight").alias("weights")))


#: Host statistics with up to so many numbers in all are broadcast; beyond, pages meet them in a shuffle, in so many parts.
BROADCAST_NUMBERS, HOST_PARTS = 4_000_000, 16


def with_host(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``pages`` with their hosts' rows."""
    numbers = hosts.agg(F.sum(F.size("known") + 2 * F.coalesce(F.size("sigs"), F.lit(0)) + 8)).first()[0] or 0
    if numbers <= BROADCAST_NUMBERS:
        return pages.join(F.broadcast(hosts), "host", "left")
    copies = hosts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
    return pages.withColumn("_s", F.pmod(F.xxhash64("row_id"), F.lit(HOST_PARTS)).cast("int")).join(copies, ["host", "_s"], "left").drop("_s")


def load(blob: bytes) -> tuple[Page, list[int], list[float], list[bool]]:
    """(page, fingerprints, points, menus) of a parsed page; the last three by unit."""
    units, nodes, fp, each, menu, lang = marshal.loads(blob)
    return Page([Node(*n) for n in nodes], [Unit(*u) for u in units], lang=lang), fp, each, menu


def main_units(page: Page, fp: list[int], each: list[float], menu: list[bool], weights: dict[int, float], known: frozenset[int]) -> list[int]:
    """The numbers of the units of the best container and of siblings that come near it, without furniture.

    Hidden units and links are among them, as keyword stuffing hides there.
    """
    nodes, units = page.nodes, page.units
    if not units:
        return []
    odd = [m or f in known for f, m in zip(fp, menu)]
    size = [min(len(u.text), UNIT_MASS) for u in units]
    masses = [0.0 if o else float(s) for o, s in zip(odd, size)]
    worth = [0.0 if o else e for e, o in zip(each, odd)]
    mass, points = subtree_sums(page, masses, PASSED), subtree_sums(page, worth, PASSED)
    number, strange = subtree_sums(page, [1.0] * len(units)), subtree_sums(page, [float(o) for o in odd])
    all_mass, all_points = sum(masses) or 1.0, sum(worth) or 1.0
    best, score = 0, 0.0
    scores = [0.0] * len(nodes)
    for i in range(1, len(nodes)):
        if not mass[i]:
            continue
        share = 0.5 * mass[i] / all_mass + 0.5 * points[i] / all_points
        scores[i] = s = share * (1 - 0.8 * strange[i] / number[i]) * weights.get(nodes[i].sig, DEFAULT_WEIGHT)
        if s > score + 1e-9:
            best, score = i, s
    keep = {best}
    if best:
        for i in range(1, len(nodes)):
            if nodes[i].parent == nodes[best].parent and scores[i] >= SIBLING * score:
                keep.add(i)
    inside = [False] * len(nodes)
    for i in range(len(nodes)):
        inside[i] = i in keep or (i > 0 and inside[nodes[i].parent] and (best != 0))
    if best == 0:
        inside = [True] * len(nodes)
    return [k for k, (u, o) in enumerate(zip(units, odd)) if inside[u.node] and not o]


class Vocabulary(dict):
    """Words to numbers from 0 on.  Lists by number have the hash of a word's lower-case form, the number of that form, and
    the word's shape: 1 for under four letters plus 2^32 for a capital at its start, so that one sum counts both.
    ``marks`` has 1 for the words that sentences are made of, which are given as hashes."""

    def __init__(self, sums: frozenset[int]):
        super().__init__()
        self.sums, self.hashes, self.lows, self.shapes, self.marks = sums, array("q"), array("q"), array("q"), array("b")

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self.hashes)
        low = word.lower()
        h = hashed(low)
        self.hashes.append(h)
        self.lows.append(k)
        self.shapes.append((len(word) < 4) + (word[0].isupper() << 32))
        self.marks.append(h in self.sums)
        if low != word:
            self.lows[k] = self[low]
        return k

    def bounded(self) -> bool:
        """Forgets all words if there are many, so that numbers had before mean nothing; True if it did."""
        if len(self) <= 200_000:
            return False
        self.clear()
        for held in (self.hashes, self.lows, self.shapes, self.marks):
            del held[:]
        return True

    def numbers(self, words) -> list[int]:
        return list(map(self.__getitem__, words))

    def known(self, numbers: set[int]) -> int:
        return sum(map(self.marks.__getitem__, numbers))


def in_parts(batches: Iterator[pd.DataFrame], sized: str) -> Iterator[pd.DataFrame]:
    """The rows of batches in parts that bound what is held at once, by the bytes in the column ``sized``."""
    for b in batches:
        start = held = 0
        for k, size in enumerate(map(len, b[sized])):
            if k > start and (k - start >= TOGETHER or held + size > TOGETHER_BYTES):
                yield b.iloc[start:k]
                start, held = k, 0
            held += size
        if start < len(b):
            yield b.iloc[start:]


def cut(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, stretches, holders): the numbers of all words of texts with plain blanks, one after the other; for each word
    the number of its stretch, counted over all texts; for each stretch the number of its text."""
    if not texts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    safe = [t if t.isascii() else t.replace(_TEXT, _NEITHER).replace(_STRETCH, _NEITHER) for t in texts]
    joined = _STOP.sub(f" {_STRETCH} ", _TEXT.join(safe)).replace(_TEXT, f" {_TEXT} ")
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = np.where(_LETTERS[codes], codes, np.uint32(32)).tobytes().decode("utf-32-le", "surrogatepass").split()
    numbers = np.fromiter(map(vocabulary.__getitem__, found), dtype=np.int64, count=len(found))
    ends = numbers == vocabulary[_TEXT]
    bars = ends | (numbers == vocabulary[_STRETCH])
    return numbers[~bars], np.cumsum(bars)[~bars], np.r_[0, np.cumsum(ends[bars])]


def distinct_pairs(groups: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.sort((groups << 32) | words)
    if len(pairs):
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    return pairs >> 32, pairs & 0xFFFFFFFF


def marked_words(pages: list[Page], vocabulary: Vocabulary) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By page the hashes of the words of stretches of text that are sentences by the words of a vocabulary, and of others."""
    vocabulary.bounded()
    texts, owner = [], []
    for k, p in enumerate(pages):
        own = [_ADDRESS.sub(" ", u.text) if "://" in u.text else u.text for u in p.units if u.text.count(" ") >= 2]
        texts += own
        owner += [k] * len(own)
    words, stretch, holder = cut(texts, vocabulary)
    n = np.bincount(stretch, minlength=len(holder))
    group, word = distinct_pairs(stretch, words)
    apart = np.bincount(group, minlength=len(holder))
    known = np.bincount(group, weights=np.array(vocabulary.marks)[word], minlength=len(holder))
    inside = (n >= 5) & (apart > 0.7 * n) & (known >= np.maximum(3, 0.3 * apart))
    page, low = np.array(owner, dtype=np.int64)[holder][group], np.array(vocabulary.lows)[word]
    hashes = np.array(vocabulary.hashes)

    def by_page(kept: np.ndarray) -> list[np.ndarray]:
        at, own = distinct_pairs(page[kept], low[kept])
        return np.split(hashes[own], np.searchsorted(at, np.arange(1, len(pages))))

    return by_page(inside[group]), by_page(((n >= 3) & ~inside)[group])


#: What a text is for: its words count, its stretches may be sentences, it is read as it stands.
COUNTED, JUDGED, READ = 1, 2, 4


@dataclass(slots=True)
class Cut:
    """The words of the regions of some pages, cut once for all that is said of them.

    ``pages`` have units, headings left out, in which ``page`` is the number of a unit's page and ``visible`` tells whether
    it is seen and isn't a link; ``unit`` and ``use`` are those of each of ``texts``; ``words``, ``stretch`` and ``holder``
    are as ``cut`` gives them; ``n`` is the number of a stretch's words.
    """

    pages: list[list[Unit]]
    page: np.ndarray
    visible: np.ndarray
    texts: list[str]
    unit: np.ndarray
    use: np.ndarray
    words: np.ndarray
    stretch: np.ndarray
    holder: np.ndarray
    n: np.ndarray


def shows(u: Unit) -> bool:
    """True for a unit that is seen and isn't a link."""
    return not u.hidden and not (u.links and u.linked >= 0.9 * len(u.text))


def cut_pages(pages: list[list[Unit]], vocabulary: Vocabulary) -> Cut:
    """The cut of pages' units, without headings.  An address is as many words as it has letters' runs, none in a sentence."""
    texts, unit, use = [], [], []
    units = [u for p in pages for u in p]
    for k, t in enumerate([u.text for u in units]):
        if "://" in t or "www." in t:
            texts += [" ".join(_ADDRESS.findall(t)), _ADDRESS.sub(" ", t), t]
            unit += [k, k, k]
            use += [COUNTED, COUNTED | JUDGED, READ]
        else:
            texts.append(t)
            unit.append(k)
            use.append(COUNTED | JUDGED | READ)
    words, stretch, holder = cut(texts, vocabulary)
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    visible = np.array([shows(u) for u in units], dtype=bool)
    return Cut(pages, page, visible, texts, np.array(unit, dtype=np.int64), np.array(use, dtype=np.int64), words, stretch, holder, np.bincount(stretch, minlength=len(holder)))


def in_sentences(c: Cut, vocabulary: Vocabulary) -> np.ndarray:
    """For each stretch of text whether it is a sentence: if enough of its words are ones that sentences are made of, or,
    where the words are garbled, if it looks like one."""
    group, word = distinct_pairs(c.stretch, c.words)
    apart = np.bincount(group, minlength=len(c.holder))
    known = np.bincount(group, weights=np.array(vocabulary.marks)[word], minlength=len(c.holder))
    judged = (c.use[c.holder] & JUDGED) > 0
    found = judged & (c.n >= 3) & (apart > 0.5 * c.n) & (known >= 0.45 * apart)
    first = np.searchsorted(c.holder, np.arange(len(c.texts)))
    for k in np.flatnonzero(judged & ~found & (c.n >= 5)).tolist():
        t = c.texts[c.holder[k]]
        if not t.isascii() and _GARBLED.search(t):
            s = _STOP.split(t)[k - first[c.holder[k]]]
            found[k] = not s.isascii() and _GARBLED.search(s) and not _ROWS.search(s) and len(set(s.split())) > 0.6 * len(s.split())
    return found


FEATURES = ("log_words", "row_share", "hidden_share", "linked_share", "links_per_word", "distinct_share", "separators_per_word", "ends_per_word", "words_per_unit", "capital_share", "short_share", "repeated_share")


def features(c: Cut, sizes: list[int], vocabulary: Vocabulary) -> list[list[float]]:
    """The content and link features of each page's region, of so many units with headings, in the order of FEATURES."""

    def by_page(pages: np.ndarray, weights: np.ndarray | None = None) -> list[int]:
        return np.bincount(pages, weights=weights, minlength=len(c.pages)).astype(np.int64).tolist()

    sentences = in_sentences(c, vocabulary)
    counted = ((c.use[c.holder] & COUNTED) > 0)[c.stretch]
    words, unit = c.words[counted], c.unit[c.holder][c.stretch[counted]]
    page, shapes, lows = c.page[unit], np.array(vocabulary.shapes)[words], np.array(vocabulary.lows)[words]
    concealed = np.array([u.hidden for p in c.pages for u in p], dtype=bool)
    sums = zip(
        by_page(page),
        by_page(c.page[c.unit[c.holder[sentences]]], c.n[sentences]),
        by_page(page[concealed[unit]]),
        by_page(page, shapes >> 32),
        by_page(page, shapes & 0xFFFFFFFF),
        by_page(c.page[distinct_pairs(unit, lows)[0]]),
        by_page(distinct_pairs(page, lows)[0]),
    )
    out = []
    for units, size, (total, inside, hidden, caps, short, apart, seen) in zip(c.pages, sizes, sums):
        text = "".join([u.text for u in units])
        linked, links, count = sum([u.linked for u in units]), sum([u.links for u in units]), text.count
        seps = count("|") + count(";") + count("#") + count(",") + count("/")
        ends = count(".") + count("!") + count("?")
        t = max(total, 1)
        out.append([log1p(total), 1 - inside / t if total else 0.0, hidden / t, linked / max(len(text), 1), links / t, seen / t, seps / t, ends / t, total / max(size, 1), caps / t, short / t, (total - apart) / t])
    return out


def sample_vocabulary(langrefs: DataFrame) -> frozenset[int]:
    """The words of the sample sentences, a table of fixed size."""
    return frozenset(hashed(w.lower()) for r in langrefs.select("sample").where(F.col("sample").isNotNull()).collect() for w in _WORD.findall(r["sample"]))


def corpus_vocabulary(parsed: DataFrame) -> frozenset[int]:
    """The words of sentences, at most ``VOCABULARY``: those in marked stretches on most pages that aren't mostly elsewhere."""
    inside = parsed.select(F.explode("words").alias("word"), F.lit(1).alias("i"))
    both = inside.union(parsed.select(F.explode("others"), F.lit(0))).groupBy("word").agg(F.sum("i").alias("inside"), F.count("*").alias("total"))
    kept = both.where((F.col("inside") >= WORD_PAGES) & (F.col("inside") >= WORD_INSIDE * F.col("total")))
    return frozenset(r["word"] for r in kept.orderBy(F.desc("inside"), "word").limit(VOCABULARY).select("word").collect())


def judge_pages(records: DataFrame, langrefs: DataFrame, with_text: bool = False, reader: tuple[str, Callable] | None = None) -> DataFrame:
    """(row_id, host, label, html_lang, features[, text], lines): what is said of each page's main body.

    ``lines`` are the numbers of the visible lines of the main body, counted from 1 with the HTTP header;
    ``features`` describe the region with its hidden text, for telling pages without sentences; ``text`` has the main
    body's units, one a line.  A page without units has no lines.  Records that are no pages give no row.

    ``reader`` says more of pages from the words cut here: (schema of its columns, maker), of which the maker, called in a
    worker with the vocabulary, gives a function from a ``Cut`` to a frame with a row a page.
    """
    spark = records.sparkSession
    samples = sample_vocabulary(langrefs)
    parsed = stored(parse_pages(records, samples))
    shared = spark.sparkContext.broadcast(samples | corpus_vocabulary(parsed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, weights = Vocabulary(shared.value), {}
        read = reader[1](vocabulary) if reader else None
        for b in in_parts(batches, "blob"):
            out, bodies, sizes = [], [], []
            if vocabulary.bounded() and reader:
                read = reader[1](vocabulary)
            for row_id, host, label, blob, known, sigs, ws in zip(b["row_id"], b["host"], b["label"], b["blob"], b["known"], b["sigs"], b["weights"]):
                page, fp, each, menu = load(blob)
                if host not in weights:
                    if len(weights) >= 1000:
                        weights.clear()
                    weights[host] = dict(zip(sigs.tolist(), ws.tolist())) if sigs is not None else {}
                region = main_units(page, fp, each, menu, weights[host], frozenset(known.tolist()) if known is not None else frozenset())
                units = [page.units[k] for k in region]
                plain = [u for u in units if u.tag not in HEADINGS and u.tag != "b"]
                lines = sorted({x for u in units if shows(u) for x in u.lines})
                text = "\n".join(u.text for u in plain if shows(u)) if with_text else None
                out.append((row_id, host, label, page.lang, text, lines))
                bodies.append(plain)
                sizes.append(len(region))
            done = pd.DataFrame(out, columns=["row_id", "host", "label", "html_lang", "text", "lines"])
            c = cut_pages(bodies, vocabulary)
            done.insert(4, "features", features(c, sizes, vocabulary))
            yield pd.concat([done, read(c)], axis=1) if read else done

    # of a host's furniture a page needs only its own lines
    pages = with_host(parsed.select("row_id", "host", "label", "fps", "blob"), host_statistics(parsed)).withColumn("known", F.array_intersect("fps", "known")).drop("fps")
    schema = "row_id bigint, host string, label string, html_lang string, features array<double>, text string, lines array<int>"
    judged = pages.mapInPandas(run, f"{schema}, {reader[0]}" if reader else schema)
    return judged if with_text else judged.drop("text")
