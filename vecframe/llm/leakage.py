"""Evaluation passages inside documents: positional postings, intersection from the rarest terms, exact verification.

A first pass counts in how many documents of the whole corpus each term of the passages occurs: words, and for Chinese and
Japanese passages four-character grams. These frequencies choose each passage's rarest terms. A second pass stores the
positional postings (term, document, positions) of these terms only; the lists, moved by the term's place in the
passage, are intersected, and every document left is compared with the passage in full. Words may be joined, broken or
spaced in a document: of each run that suffices one gram of the joined words is posted too, wherever it is found. The
passages are taken in blocks of a checked size.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import pandas as pd
from ahocorasick import Automaton
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecframe.runtime import BROADCAST_BYTES, broadcast_if, materialize, spread

WORDS_IN_A_ROW = 12
CHARACTERS_IN_A_ROW = 20
SHARE = 0.8
#: A stretch of similar length: at most this many times the passage's words.
STRETCH = 1.3
#: Rarest terms that any match is sure to hold.
ANCHORS = 3
_GRAM = 4
#: Passages of one block, in bytes of text.
PASSAGE_BYTES = BROADCAST_BYTES // 8
#: Characters of the grams of joined words; a run of as many words has as many at least.
_RUN_GRAM = WORDS_IN_A_ROW
# Accents that are dropped, characters that show nothing, scripts without spaces between words.
_DROPPED = re.compile("[̀-ͯ­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")


def words(text: str) -> list[str]:
    """The words of a text without case, accents, punctuation, markup signs and invisible characters."""
    if text.isascii():
        return _WORD.findall(text.lower())
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return _WORD.findall(unicodedata.normalize("NFC", _DROPPED.sub("", t)))


def _grams(stream: str) -> list[str]:
    return [stream[i : i + _GRAM] for i in range(len(stream) - _GRAM + 1)]


@dataclass
class Passage:
    item: int
    words: list[str]
    dense: bool
    terms: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.terms = _grams("".join(self.words)) if self.dense else self.words

    def anchors(self, df: Counter) -> list[int]:
        """Places of the rarest terms, such that any match of the passage holds :data:`ANCHORS` of them at least.

        A run of the least length is a window over the places; a looser match lacks a fifth of the words at most.
        """
        n = len(self.terms)
        window = min(n, CHARACTERS_IN_A_ROW - _GRAM + 1 if self.dense else WORDS_IN_A_ROW)
        some = min(n if self.dense else n - int(n * (1 - SHARE) + 1e-9), ANCHORS, window)
        total = 0 if self.dense else int(n * (1 - SHARE) + 1e-9) + some
        chosen: set[int] = set()
        for place in sorted(range(n), key=lambda i: (df[self.terms[i]], i)):
            windows = range(max(0, place - window + 1), min(place, n - window) + 1)
            if len(chosen) < total or any(sum(i in chosen for i in range(w, w + window)) < some for w in windows):
                chosen.add(place)
        return sorted(chosen)

    def run_grams(self) -> list[str]:
        """Grams of the joined words, as few as possible, of which each run of the least length holds one."""
        stream, starts, chosen = "".join(self.words), [0], []
        for w in self.words:
            starts.append(starts[-1] + len(w))
        for i in range(0 if self.dense else len(self.words) - WORDS_IN_A_ROW + 1):
            if not chosen or chosen[-1] < starts[i]:
                chosen.append(starts[i + WORDS_IN_A_ROW] - _RUN_GRAM)
        return [stream[x : x + _RUN_GRAM] for x in chosen]

    @property
    def least_anchors(self) -> int:
        n = len(self.terms)
        window = min(n, CHARACTERS_IN_A_ROW - _GRAM + 1 if self.dense else WORDS_IN_A_ROW)
        return max(1, min(n if self.dense else n - int(n * (1 - SHARE) + 1e-9), ANCHORS, window))


def passages(items: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> Iterator[list[Passage]]:
    """The passages on the driver, by blocks that fit a broadcast; the blocks go by a hash of the id."""
    lang = F.lower(F.col(lang_col)) if lang_col else F.lit(None).cast("string")
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), lang.alias("l")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // PASSAGE_BYTES)
    for block in range(blocks):
        out = []
        for i, t, code in rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).dropDuplicates(["i"]).collect():
            w = words(t)
            letters = "".join(w)
            dense = (code or "")[:2] in ("zh", "ja") or 2 * len(_CJK.findall(letters)) > len(letters)
            if len(letters) >= (CHARACTERS_IN_A_ROW if dense else 1):
                out.append(Passage(i, w, dense))
        if out:
            yield out


def _frequencies(vocabulary):
    """(term, docs) of each partition: how many of its documents hold each known word or gram."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, in_grams = vocabulary.value
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"].tolist():
                tokens = words(text)
                seen.update(terms.keys() & set(tokens))
                if in_grams and _CJK.search(text):
                    seen.update((g,) for g in in_grams.keys() & set(_grams("".join(tokens))))
        found = [((in_grams[g[0]] if isinstance(g, tuple) else terms[g]), n) for g, n in seen.items()]
        yield pd.DataFrame(found, columns=["term", "docs"]).astype({"term": "int32", "docs": "int64"})

    return scan


def _postings(vocabulary):
    """(term, doc, at): where a document holds each anchor."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, in_grams, in_runs = vocabulary.value
        runs = Automaton()
        for g, k in in_runs.items():
            runs.add_word(g, k)
        runs.make_automaton()
        for b in batches:
            rows = []
            for doc, text in zip(b["id"].tolist(), b["text"].tolist()):
                found: dict[int, list[int]] = {}
                tokens = words(text)
                if terms.keys() & set(tokens):
                    for at, w in enumerate(tokens):
                        if (k := terms.get(w)) is not None:
                            found.setdefault(k, []).append(at)
                stream = "".join(tokens)
                if in_grams and _CJK.search(text):
                    for at, g in enumerate(_grams(stream)):
                        if (k := in_grams.get(g)) is not None:
                            found.setdefault(k, []).append(at)
                if in_runs:
                    found |= {k: [0] for _, k in runs.iter(stream)}
                rows += [(k, doc, at) for k, at in found.items()]
            yield pd.DataFrame(rows, columns=["term", "doc", "at"])

    return scan


def _in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(b):
        places.setdefault(w, []).append(i)
    ends: list[int] = []
    for w in a:
        for i in reversed(places.get(w, ())):
            k = bisect_left(ends, i)
            ends[k : k + 1] = [i]
    return len(ends)


def holds(passage: Passage, tokens: list[str], stream: str, bounds: set[int]) -> bool:
    """Whether a document's words hold the passage, by the runs or the share in order that its language asks for.

    ``stream`` is the joined words and ``bounds`` the places in it where a word begins or ends.
    """
    if passage.dense:
        p = "".join(passage.words)
        return any(p[i : i + CHARACTERS_IN_A_ROW] in stream for i in range(len(p) - CHARACTERS_IN_A_ROW + 1))
    n = len(passage.words)
    for i in range(n - WORDS_IN_A_ROW + 1):
        some = passage.words[i : i + WORDS_IN_A_ROW]
        run = "".join(some)
        at = stream.find(run)
        while at >= 0:
            # a word at either end is whole, or the text joins it to the next word of the run
            end = at + len(run)
            if (at in bounds or at + len(some[0]) not in bounds) and (end in bounds or end - len(some[-1]) not in bounds):
                return True
            at = stream.find(run, at + 1)
    least = -(-n * 8 // 10)
    long = int(n * STRETCH)
    known = set(passage.words)
    hits = [i for i, w in enumerate(tokens) if w in known]
    need = end = 0
    for x in range(len(hits) - least + 1):
        if hits[x + least - 1] - hits[x] < long:
            # a stretch has at most as many words in order as one before it, and those that it has gained since
            last = bisect_left(hits, hits[x] + long)
            if last - end < need:
                continue
            order = _in_order(passage.words, tokens[hits[x] : hits[x] + long])
            if order >= least:
                return True
            need, end = least - order, last
    return False


def _verify(by_item):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = by_item.value
        for b in batches:
            rows = []
            for doc, text, items in zip(b["id"].tolist(), b["text"].tolist(), b["items"].tolist()):
                tokens = words(text)
                stream, bounds = "".join(tokens), {0, *accumulate(map(len, tokens))}
                rows += [(doc, i) for i in items if holds(known[i], tokens, stream, bounds)]
            yield pd.DataFrame(rows, columns=["id", "item"]).astype("int64")

    return scan


def leaked(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str = "item_id", passage_col: str = "passage", lang_col: str | None = "lang") -> DataFrame:
    """(id, item): the documents that hold a passage, wholly or in part, and the passage's item.

    Held are :data:`WORDS_IN_A_ROW` consecutive words or, in a stretch of similar length, :data:`SHARE` of all words in
    order; of a Chinese or Japanese passage :data:`CHARACTERS_IN_A_ROW` consecutive characters. Null and empty texts and
    passages hold nothing; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    found = [_leaked(texts, known) for known in passages(items, item_col, passage_col, lang_col)]
    return reduce(DataFrame.unionAll, found) if found else texts.sparkSession.createDataFrame([], "id long, item long")


def _leaked(texts: DataFrame, known: list[Passage]) -> DataFrame:
    """The documents that hold passages of one block."""
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    number = {t: i for i, t in enumerate(sorted({(p.dense, t) for p in known for t in p.terms}))}

    def by_kind(chosen: set[tuple[bool, str]]) -> tuple[dict[str, int], dict[str, int]]:
        return tuple({t: number[dense, t] for dense, t in chosen if dense == kind} for kind in (False, True))

    wide = spread(texts)
    counts = wide.mapInPandas(_frequencies(share(by_kind(set(number)))), "term int, docs long").groupBy("term").agg(F.sum("docs"))
    counted = dict(counts.collect())  # one row a term of the block's passages at most
    runs = {g: len(number) + i for i, g in enumerate(sorted({g for p in known for g in p.run_grams()}))}
    rows, chosen = [], set()
    for p in known:
        df = Counter({t: counted.get(number[p.dense, t], 0) for t in p.terms})
        n = max(8, len(p.terms) // 2)
        places = p.anchors(df)
        chosen |= {(p.dense, p.terms[i]) for i in places}
        rows += [(number[p.dense, p.terms[i]], p.item, i, p.least_anchors, n) for i in places]
        rows += [(runs[g], p.item, 0, 1, 1 << 30) for g in p.run_grams()]  # one suffices, at any place
    postings = materialize(wide.mapInPandas(_postings(share((*by_kind(chosen), runs))), "term int, doc long, at array<int>"))
    anchors = broadcast_if(spark.createDataFrame(rows, "term int, item long, place int, least int, width int"), len(rows), 32)
    # by document, once: the intersection and the candidates need no other partitioning
    hits = postings.repartition("doc").join(anchors, "term").select("doc", "item", "place", "least", "width", F.explode("at").alias("at"))
    moved = F.floor((F.col("at") - F.col("place")) / F.col("width"))
    near = hits.select("doc", "item", "place", "least", F.explode(F.array(moved, moved + 1)).alias("band"))
    pairs = near.groupBy("doc", "item", "least", "band").agg(F.count_distinct("place").alias("n")).where("n >= least")
    candidates = materialize(pairs.groupBy(F.col("doc").alias("id")).agg(F.collect_set("item").alias("items")))
    size = candidates.agg(F.sum(F.size("items") * 8 + 64)).first()[0] or 0
    small = F.broadcast(candidates) if size <= BROADCAST_BYTES else candidates
    return texts.join(small, "id").mapInPandas(_verify(share({p.item: p for p in known})), "id long, item long").distinct()


def p7_leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaked(docs, "doc_id", "text", items)
