"""Language of pages and of the segments of mixed pages by Bayesian evidence fusion.

Evidence of a page's language: the likelihood of its sentences' words under models of the sample sentences, the declared
markup language, the suffix of the host's address, and the languages of other pages on the host.  The priors of hosts
are smoothed towards those of their suffix, these towards those of the corpus, all from counts by grouped aggregation.
A sentence's language is fused from its own likelihood and its page's.

A sentence in another language than its page's may be a stray line, a label or formula that stands on pages of any
language, and says nothing of the body.  The corpus tells: the same sentence, names and numbers left out, is then found
on pages of several languages, at rates like those on pages of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .mainbody import READ, Cut, Vocabulary, hashed, judge_pages, words_of

#: Log-likelihood of a known word over that of an unknown one is bounded, so that no single word decides.
MOST_A_WORD = 4.0
#: How far a declared language is trusted; how many pages the prior of the wider level counts as.
DECLARED, PRIOR_PAGES = 0.7, 20.0
#: The share of a page's sentences expected in other languages than its own.
MIXING = 0.1
#: A sentence counts for another language than its page's if its posterior is at least this.
SURE = 0.8
#: A sentence is a stray line if it is on pages of so many languages besides its own, and is on a part of these as large,
#: but for this factor, as the part of the pages of its own language that it is on.
STRAY_LANGUAGES, STRAY_RATE = 3, 0.2
#: Whole sentences that a language needs to be one of a body's languages.
LEAST_SENTENCES = 2

_WORD = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ʯͰ-῿Ⰰ-\u2fff\u3040-\ud7ff]+")
_CUT = re.compile("[.!?…]+[\"”»“'’)\\]]*[.…]*\\s+")
_ENDS = re.compile("[.!?…][\"”»“'’)\\].…]*$")


class Model:
    """Word likelihoods by language from the sample sentences, with letter trigrams for words that aren't there."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in rows})
        words = {g: Counter() for g in self.langs}
        grams = {g: Counter() for g in self.langs}
        for lang, sample in rows:
            for w in _WORD.findall(sample):
                if w[0].isupper() and w.isascii() and lang == "ru":
                    continue  # place names in other letters
                words[lang][w.lower()] += 1
                grams[lang].update(self.grams(w.lower()))
        self.words = {}
        every = set().union(*words.values()) if words else set()
        total = {g: sum(words[g].values()) for g in self.langs}
        for w in every:
            p = np.array([math.log((words[g][w] + 0.05) / (total[g] + 0.05 * len(every))) for g in self.langs])
            self.words[w] = np.maximum(p - p.max(), -MOST_A_WORD)
        kinds = len(set().union(*grams.values())) if grams else 1
        sums = {g: sum(grams[g].values()) for g in self.langs}
        self.gram = {}
        for t in set().union(*grams.values()) if grams else ():
            self.gram[t] = np.array([math.log((grams[g][t] + 0.3) / (sums[g] + 0.3 * kinds)) for g in self.langs])
        self.no_gram = np.array([math.log(0.3 / (sums[g] + 0.3 * kinds)) for g in self.langs])

    @staticmethod
    def grams(w: str) -> list[str]:
        w = f"^{w}$"
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def row(self, w: str) -> np.ndarray:
        """A word's log-likelihood for each language, up to a constant."""
        low = w.lower()
        v = self.words.get(low)
        if v is None:
            if w[0].isupper() and w.isascii():
                v = np.zeros(len(self.langs))  # most likely a name
            else:
                v = sum(self.gram.get(t, self.no_gram) for t in self.grams(low))
                v = 0.5 * np.maximum(v - v.max(), -MOST_A_WORD)
        return v

    def form(self, w: str) -> str:
        """What stands for a word in the pattern of a sentence: words that the samples don't have and names are left open."""
        low = w.lower()
        return "^" if w[0].isupper() else low if low in self.words else "*"


def whole_sentences(text: str) -> list[list[str]]:
    """The words of the stretches of a text, a block a line, that end as sentences do and have at least three words."""
    found = []
    for block in text.split("\n"):
        pieces = _CUT.split(block)
        if not _ENDS.search(pieces[-1]):
            pieces.pop()
        for s in pieces:
            words = words_of(s)
            if len(words) >= 3:
                found.append(words)
    return found


class Reader:
    """What the words of pages' main bodies say of languages, from their cut by a vocabulary.

    Columns: ``said``, whether there is any text; ``total`` and ``each``, the log-likelihoods of the whole text and of each
    whole sentence, the languages one after the other; ``top`` and ``tops``, the likeliest languages; ``patterns``, a number
    that sentences made from the same pattern have in common.  Whole sentences are as ``whole_sentences`` has them; without
    any the likelihood is that of all words.
    """

    SCHEMA = "said boolean, top int, total array<double>, each array<float>, tops array<int>, patterns array<bigint>"

    def __init__(self, model: Model, vocabulary: Vocabulary):
        self.model, self.vocabulary = model, vocabulary
        self.rows, self.have, self.forms = np.zeros((0, len(model.langs))), np.zeros(0, dtype=bool), []

    def _learn(self, numbers: np.ndarray) -> None:
        size = len(self.vocabulary)
        if size > len(self.have):
            more = max(size, 2 * len(self.have)) - len(self.have)
            self.rows = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]))])
            self.have = np.concatenate([self.have, np.zeros(more, dtype=bool)])
            self.forms += [""] * more
        new = np.unique(numbers[~self.have[numbers]]).tolist()
        words = list(self.vocabulary) if new else []  # in the order of their numbers
        for k in new:
            self.rows[k], self.forms[k] = self.model.row(words[k]), self.model.form(words[k])
        self.have[new] = True

    def __call__(self, c: Cut) -> pd.DataFrame:
        read = ((c.use & READ) > 0) & c.visible[c.unit]
        ends = np.array([r and _ENDS.search(t.rpartition(" ")[2]) is not None for r, t in zip(read.tolist(), c.texts)], dtype=bool)
        last = np.r_[c.holder[1:] != c.holder[:-1], np.ones(min(len(c.holder), 1), dtype=bool)]
        whole = read[c.holder] & (c.n >= 3) & (~last | ends[c.holder])
        page = c.page[c.unit[c.holder]]
        number = np.bincount(page[whole], minlength=len(c.pages))
        spare = read[c.holder] & (number[page] == 0)  # of pages without whole sentences
        words, others, to = c.words[whole[c.stretch]], c.words[spare[c.stretch]], page[c.stretch[spare[c.stretch]]]
        starts = np.cumsum(c.n[whole]) - c.n[whole]
        firsts = np.array(self.vocabulary.lows, dtype=np.int64)[words[starts]]
        self._learn(np.concatenate([words, others, firsts]))
        each = np.add.reduceat(self.rows[words], starts, axis=0) if len(starts) else np.zeros((0, self.rows.shape[1]))
        tops = each.argmax(1).astype(np.int32)
        form, forms = self.forms.__getitem__, list(map(self.forms.__getitem__, words.tolist()))
        patterns = [hashed(" ".join([form(f), *forms[s + 1 : s + n]])) for f, s, n in zip(firsts.tolist(), starts.tolist(), c.n[whole].tolist())]
        total = np.zeros((len(c.pages), self.rows.shape[1]))
        for k in np.unique(to).tolist():
            total[k] = np.add.reduceat(self.rows[others[to == k]], [0], axis=0)[0]
        out = []
        cuts = np.r_[0, np.cumsum(number)].tolist()
        held = np.bincount(c.page[c.visible], minlength=len(c.pages)) > 0
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            if e > s:
                total[k] = each[s:e].sum(0)
            out.append((total[k], each[s:e].astype(np.float32).ravel(), tops[s:e], patterns[s:e]))
        found = pd.DataFrame(out, columns=["total", "each", "tops", "patterns"])
        return found.assign(said=held, top=total.argmax(1).astype(np.int32))


def declared(label: str | None) -> str:
    return re.split(r"[-_]", (label or "").strip().lower())[0]


def _priors(scored: DataFrame, langs: list[str]) -> DataFrame:
    """(host, prior): smoothed log priors of each host.  ``scored`` has host, suffix, the likeliest language ``top`` and
    ``body``; pages without a main body don't count, but their hosts get priors too."""
    counts = scored.groupBy("suffix", "host", "top").agg(F.sum(F.col("body").cast("long")).alias("count"))
    hosts = counts.groupBy("suffix", "host").agg(*[F.sum(F.when(F.col("top") == i, F.col("count")).otherwise(0)).alias(f"h{i}") for i in range(len(langs))], F.sum("count").alias("hn"))
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"h{i}").alias(f"s{i}") for i in range(len(langs))], F.sum("hn").alias("sn"))
    every = suffixes.agg(*[F.sum(f"s{i}").alias(f"c{i}") for i in range(len(langs))], F.sum("sn").alias("cn"))
    p = hosts.join(suffixes, "suffix").crossJoin(F.broadcast(every))  # ``every`` is a single row
    corpus = [(F.col(f"c{i}") + 1) / (F.col("cn") + len(langs)) for i in range(len(langs))]
    suffix = [(F.col(f"s{i}") + PRIOR_PAGES * c) / (F.col("sn") + PRIOR_PAGES) for i, c in enumerate(corpus)]
    host = [F.log((F.col(f"h{i}") + PRIOR_PAGES * s) / (F.col("hn") + PRIOR_PAGES)) for i, s in enumerate(suffix)]
    return p.select("host", F.array(*host).alias("prior"))


def _strays(scored: DataFrame) -> DataFrame:
    """(row_id, strays): the patterns of the page's sentences in another language than the page's that are stray lines."""
    every = scored.select("row_id", "top", F.inline(F.arrays_zip("tops", "patterns"))).select("row_id", "top", F.col("tops").alias("lang"), F.col("patterns").alias("pattern"))
    other = stored(every.where("lang <> top"))  # few sentences are
    wide = stored(other.groupBy("pattern", "lang").agg(F.countDistinct("row_id").alias("others"), F.countDistinct("top").alias("tops")).where(F.col("tops") >= STRAY_LANGUAGES).drop("tops"))
    own = every.where("lang = top").join(wide.select("pattern", "lang"), ["pattern", "lang"], "left_semi").groupBy("pattern", "lang").agg(F.countDistinct("row_id").alias("own"))
    pages = scored.groupBy(F.col("top").alias("lang")).agg(F.count("*").alias("same"))  # a row a language
    pages = pages.select("lang", "same", (F.sum("same").over(Window.partitionBy(F.lit(0))) - F.col("same")).alias("different"))
    rates = wide.join(own, ["pattern", "lang"], "left").join(pages, "lang", "left")
    stray = rates.where(F.col("others") * F.coalesce("same", F.lit(1)) >= STRAY_RATE * F.coalesce("own", F.lit(0)) * F.coalesce("different", F.lit(1))).select("pattern", "lang")
    return other.join(stray, ["pattern", "lang"], "left_semi").groupBy("row_id").agg(F.collect_set("pattern").alias("strays"))


_LANGUAGES = "row_id bigint, body boolean, label string, lang string, confidence double, sentences map<string,int>, segments array<struct<lang:string,first:int,number:int,confidence:double>>"


def page_languages(scored: DataFrame, langs: list[str]) -> DataFrame:
    """(row_id, body, label, lang, confidence, sentences, segments): languages of all pages.

    ``scored`` is a stored table with a ``Reader``'s columns and ``body``, false for pages without a main body and those
    whose main body has no text.  Their language comes out with the others', by what text there is, labels and priors, but
    says nothing of other pages.

    ``lang`` and ``confidence`` are the page's language and its posterior probability, ``sentences`` the number of whole
    sentences by language without stray lines, ``segments`` the runs of sentences of one language (lang, first sentence, number,
    confidence).  A page without whole sentences has no segments.
    """
    n = len(langs)
    joined = scored.drop("tops").join(stored(_priors(scored, langs)), "host", "left").join(stored(_strays(scored.where("body"))), "row_id", "left")

    place = {g: i for i, g in enumerate(langs)}
    others = math.log((1 - DECLARED) / (n - 1 or 1))
    here = math.log(DECLARED) - others

    mixes = np.full((n, n), math.log(MIXING / (n - 1 or 1)))
    np.fill_diagonal(mixes, math.log(1 - MIXING))

    def fuse_some(b: pd.DataFrame) -> pd.DataFrame:
        k, number = len(b), np.array([len(x) // n for x in b["each"]])
        said = np.zeros((k, n))
        for column in ("label", "html_lang"):
            for i, d in enumerate(map(declared, b[column])):
                if d in place:
                    said[i] += others
                    said[i, place[d]] += here
        # a page's sentences aren't independent evidence: their weight falls off with their number
        page = np.stack(b["prior"].to_numpy()) + 0.5 * said + np.stack(b["total"].to_numpy()) / np.sqrt(np.maximum(number, 1))[:, None]
        page = np.exp(page - page.max(1, keepdims=True))
        page /= page.sum(1, keepdims=True)
        own = page.argmax(1)
        # all pages' sentences one after the other
        at, starts = np.repeat(np.arange(k), number), np.cumsum(number) - number
        post = np.concatenate(b["each"].to_numpy()).astype(np.float64).reshape(-1, n) + mixes[own[at]]
        post = np.exp(post - post.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        tops = post.argmax(1)
        sure = post[np.arange(len(tops)), tops]
        certain = sure >= SURE
        for i, (patterns, stray) in enumerate(zip(b["patterns"], b["strays"])):
            if stray is not None:
                certain[starts[i] : starts[i] + number[i]] &= ~np.isin(patterns, stray)
        counted = (tops == own[at]) | certain
        counts = np.bincount(at[counted] * n + tops[counted], minlength=k * n).reshape(k, n).tolist()
        segments: list[list[dict]] = [[] for _ in range(k)]
        if len(tops):
            cuts = np.flatnonzero(np.r_[True, (tops[1:] != tops[:-1]) | (at[1:] != at[:-1])])
            runs = np.diff(np.r_[cuts, len(tops)])
            for i, g, first, m, mean in zip(at[cuts].tolist(), tops[cuts].tolist(), (cuts - starts[at[cuts]]).tolist(), runs.tolist(), (np.add.reduceat(sure, cuts) / runs).tolist()):
                segments[i].append({"lang": langs[g], "first": first, "number": m, "confidence": mean})
        by_language = [{langs[g]: c for g, c in enumerate(row) if c} for row in counts]
        return pd.DataFrame({"row_id": b["row_id"], "body": b["body"], "label": b["label"], "lang": [langs[g] for g in own], "confidence": page[np.arange(k), own], "sentences": by_language, "segments": segments})

    def fuse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 500):
                yield fuse_some(b.iloc[s : s + 500])

    return joined.select("row_id", "body", "label", "html_lang", "total", "each", "prior", "patterns", "strays").mapInPandas(fuse, _LANGUAGES)


def doubtful_labels(languages: DataFrame) -> DataFrame:
    """(row_id, lang): the languages with enough whole sentences of pages that have a main body
    and a missing or wrong label or a mixed body."""
    many = F.map_keys(F.map_filter("sentences", lambda _, k: k >= LEAST_SENTENCES))
    code = F.element_at(F.split(F.lower(F.trim(F.coalesce("label", F.lit("")))), "[-_]"), 1)
    cases = languages.withColumn("many", many).where("body").where((F.size("many") > 1) | (code != F.col("lang")))
    return cases.select("row_id", F.explode("many").alias("lang"))


def language_segments(languages: DataFrame) -> DataFrame:
    """(row_id, page_lang, page_confidence, lang, first, number, confidence): a row a segment; a page without segments has
    one row, in which nothing but the page's language is given."""
    return languages.select("row_id", F.col("lang").alias("page_lang"), F.round("confidence", 4).alias("page_confidence"), F.inline_outer("segments"))


def main_languages(records: DataFrame, langrefs: DataFrame, spam, every: bool = True) -> DataFrame:
    """``page_languages`` of all pages among ``records``, or of those with a main body; ``spam`` picks the pages without one.

    Without sample sentences there are no languages and no rows.
    """
    spark = records.sparkSession
    rows = [(r["lang"], r["sample"]) for r in langrefs.collect() if r["lang"] and r["sample"]]  # a table of fixed size
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return spark.createDataFrame([], _LANGUAGES)
    shared = spark.sparkContext.broadcast(rows)
    kept: dict = {}

    def reader(vocabulary: Vocabulary) -> Reader:
        if "m" not in kept:
            kept["m"] = Model(shared.value)
        return Reader(kept["m"], vocabulary)

    judged = stored(judge_pages(records, langrefs, reader=(Reader.SCHEMA, reader)).drop("lines"))
    without = stored(spam(judged).select("row_id").distinct()).withColumn("without", F.lit(True))
    marked = judged.drop("features").join(without, "row_id", "left")
    marked = (marked if every else marked.where("without IS NULL")).withColumn("body", F.col("without").isNull() & F.col("said"))
    return page_languages(stored(marked.drop("without", "said").withColumn("suffix", F.substring_index("host", ".", -1))), langs)
