"""Defective prompt and response pairs: empty, truncated, refusal, echo, or in another language.

Languages come from a naive Bayes classifier over character n-grams, fitted on a bounded sample of labelled documents.
Refusals come from a second such classifier, of sentences, beside wordings that are known to decline.
Truncation comes from the likelihood that a text ends after its last characters: how often these occur at an end, of how
often they occur at all, counted over the responses of the whole table, beside unclosed brackets and fences. The last item of a
list may lack an end mark: for it, a sentence's or an item's end counts like a text's; an item of one word, which is a
name or value, is compared with the beginnings of all items.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.llm.refusals import CUE, Refusals
from vecframe.runtime import BROADCAST_BYTES, broadcast_if, materialize, spread

#: Labelled documents of each language that the classifier is fitted on, at most, and their characters, but for the last
#: document; their choice goes by a hash of the id. Languages that the classifier knows at most, those of most documents.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGES = 300, 300_000, 250
#: Languages from which on a word that none of them has far more often than the next one tells nothing.
SHARED_BY = 4
#: Responses that the model of refusals takes for answers, by a hash of their id.
SAMPLE_RESPONSES = 2000
#: A text ends after its last characters less often than this: it is truncated.
END_SHARE = 0.08
#: Characters of an ending, longest first, and how often it must occur to count.
ENDINGS, SUPPORT = (12, 5), 20
# Marks of a missing value, without punctuation and in lower case.
MISSING = {"", "null", "none", "na", "nan", "nil", "undefined", "missing", "empty", "notavailable", "noanswer", "keineangabe", "ka", "sindatos", "nd", "无", "なし"}
# What introduces a repeated prompt.
INTRODUCTIONS = {
    "youasked", "yousaid", "yourquestion", "yourquestionwas", "question", "prompt", "q", "user", "frage", "duhastgefragt", "siefragten", "deinefrage", "ihrefrage",
    "sure", "ofcourse", "certainly", "okay", "ok", "gerne", "klar", "natürlich", "selbstverständlich", "biensûr", "daccord", "claro", "porsupuesto", "当然", "好的", "もちろん", "もちろんです", "はい",
    "votrequestion", "vousavezdemandé", "pregunta", "supregunta", "tupregunta", "preguntaste", "问题", "您问", "你问", "您的问题", "質問", "ご質問", "質問は",
}
# The names of the languages in each of them.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles 英文 英语 英語", "de": "german deutsch allemand alemán aleman 德文 德语 ドイツ語", "fr": "french französisch français francais francés frances 法文 法语 フランス語",
    "es": "spanish spanisch espagnol español espanol castellano 西班牙文 西班牙语 スペイン語", "zh": "chinese chinesisch chinois chino 中文 汉语 中国語", "ja": "japanese japanisch japonais japonés japones 日文 日语 日本語",
}
#: Wordings that decline to answer: somebody who is not able, allowed or willing, and what they won't do.
_REFUSALS = re.compile(
    r"\b(?:i|we)(?:'m| am|'re| are)? ?(?:can ?not|can't|won't|will not|must|have to|am|not|unable|able|cannot|do not|don't|prefer|not able|decline)[a-z ,']{0,40}?\b(?:help|assist|answer|provide|discuss|comment|respond|comply|share|decline|refuse)\b"
    r"|\bnot something i can\b|\b(?:guidelines|policy|policies|rules) (?:do not|don't|does not|doesn't) (?:permit|allow)|\bwhat i(?:'m| am) (?:allowed|permitted)|\boff[- ]limits for me|^\W*no comment\b|\bcannot provide (?:this|that|any)\b"
    r"|\bkann (?:ich )?(?:leider )?[^.]{0,60}nicht (?:weiter)?(?:helfen|beantworten|geben)|\b(?:dabei|damit|hierbei) kann ich [^.]{0,20}nicht|\bich [^.]{0,40}\bablehnen\b|möchte ich mich nicht äußern|\bkeine auskunft\b|\bdarf ich [^.]{0,40}(?:nicht|keine)\b"
    r"|\bne (?:peux|puis) pas (?:vous |t'|te )?(?:aider|répondre|fournir|donner|en parler)|préfère ne pas (?:répondre|en parler)|ne suis pas autorisée? à|\bm'est impossible de|\bje (?:dois|refuse)[^.]{0,20}(?:refuser|décliner|de répondre)"
    r"|\bno puedo (?:ayudar|dar|responder|contestar|proporcionar|hablar)|\bno me está permitido|\bno tengo permitido|prefiero no (?:contestar|responder|hablar)|\bno estoy autorizad[oa]"
    r"|无法(?:帮助|回答|提供|协助|处理)|不能(?:回答|提供|帮助|讨论)|不便(?:讨论|回答|透露|提供)|拒绝回答"
    r"|(?:お答え|お手伝い|お話し|回答|対応|提供)(?:は|することは)?できません|お断り"
)
#: What answers: code, and names of files, fields and commands.
_ANSWERS = re.compile(r"```|[A-Za-z0-9_/-]*[A-Za-z0-9]{2}(?:_|\.(?=[a-z]|[A-Z]{2}))[A-Za-z][A-Za-z0-9_]+")
_ADDRESS = re.compile(r"https?://[!-~]+|[!-~]+@[!-~]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n\s*\n")
_TAG = re.compile(r"<[^<>]{0,200}>|&[a-z]{2,8};|&#\d+;")
_QUOTE = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|`[^`]*`")
_NEUTRAL = re.compile(r"```.*?(?:```|$)|`[^`]*`|https?://[!-~]+|[A-Za-z0-9_/-]*[A-Za-z][._][A-Za-z0-9][A-Za-z0-9_./-]*|(?<![A-Za-z])[a-z]+[A-Z][A-Za-z]*|(?<![A-Za-z])[A-Z]{2,}(?![A-Za-z])|\d+", re.S)
_QUOTE_MARKS, _BRACKETS = frozenset("\"“„«「`"), frozenset("([{（「『«")
_NO_WORD = re.compile(r"[\W_]+")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_FINAL = re.compile(r"[.!?。！？…؟।][\"'”’»」』）)\]*_`]*$")
_MARKER = r"(?:^|\n)[^\S\n]*(?:[-*•]|\d+[.)])"
_ITEM, _BARE_MARKER = re.compile(_MARKER + r" ([^\n]*)"), re.compile(r"\n[^\S\n]*(?:[-*•]|\d+[.)])$")
#: Characters behind the end of an item or sentence.
_AFTER_END = frozenset("\n.!?。！？…؟।")
# Words that no item ends in.
LINKS = set("the an of and or with from your my our der die das dem den des ein eine einen einem einer und oder mit le les un une des du de et ou avec el los las del y o con".split())


def bare(text: str) -> str:
    """The letters and digits of a text in lower case."""
    t = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return _NO_WORD.sub("", t.casefold())


class Languages:
    """Naive Bayes over the character n-grams of 1 to 3 of the words of texts, without neutral tokens (code, names of files, numbers)."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.names = sorted(texts)
        counts = [Counter(g for t in texts[k] for g in self.grams(t)) for k in self.names]
        kept = sorted({g for c in counts for g, n in c.items() if n > 2})
        self.rows = {g: i for i, g in enumerate(kept)}
        table = np.array([[c[g] for c in counts] for g in kept], float).reshape(len(kept), len(self.names)) + 0.1
        self.table = np.log(table / table.sum(axis=0)).astype(np.float32)
        self.shared = self._shared([Counter(w for t in texts[k] for w in set(self.words(t))) for k in self.names], [max(1, len(texts[k])) for k in self.names])
        self.known: dict[str, np.ndarray | None] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        return _NO_WORD.sub(" ", _NEUTRAL.sub(" ", text).lower()).split()

    @staticmethod
    def _shared(counts: list[Counter], documents: list[int]) -> set[str]:
        """Words of the subject that texts of many languages hold about as often, and which tell none of them."""
        out = set()
        for w in {w for c in counts for w in c}:
            rates = sorted((c[w] / n for c, n in zip(counts, documents) if c[w]), reverse=True)
            if len(rates) >= SHARED_BY and rates[0] < 10 * rates[1]:
                out.add(w)
        return out

    @classmethod
    def grams(cls, text: str) -> Iterator[str]:
        for w in cls.words(text):
            yield from w
            w = f" {w} "
            yield from map("".join, zip(w, w[1:]))
            yield from map("".join, zip(w, w[1:], w[2:]))

    def score(self, word: str) -> np.ndarray | None:
        """The summed log likelihoods of a word's n-grams; words recur, so they are kept."""
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            rows = [i for i in map(self.rows.get, self.grams(word)) if i is not None]
            self.known[word] = self.table[rows].sum(axis=0) if rows else None
        return self.known[word]

    def posterior(self, text: str) -> tuple[str, float] | None:
        """The likeliest language and the log odds to the next one; None if too few letters are left to tell."""
        words = self.words(text)
        own = "".join(words)
        if not self.names or len(own) + 2 * len(_DENSE.findall(own)) < 12:
            return None
        scores = [x for x in map(self.score, (w for w in words if w not in self.shared)) if x is not None]
        if not scores:
            return None
        score = sum(scores)
        order = np.argsort(-score)
        return self.names[order[0]], float(score[order[0]] - score[order[1]]) if len(order) > 1 else math.inf


def is_empty(response: str | None) -> bool:
    return response is None or bare(_TAG.sub(" ", response)) in MISSING


def is_echo(prompt: str, response: str) -> bool:
    p, r = bare(prompt), bare(response)
    if not p or len(p) < 3:
        return False
    if p in r:
        rest = r.replace(p, "")
        return rest == "" or rest in INTRODUCTIONS
    # the prompt without its greeting, or with its words restyled
    return len(r) >= 0.6 * len(p) and any(p.endswith(x) for x in {r, *(r[len(i) :] for i in INTRODUCTIONS if r.startswith(i))} if len(x) >= 0.6 * len(p))


def is_refusal(response: str, prompt: str = "", model: Refusals | None = None) -> bool:
    """Whether it declines, at any length, before it has answered by code or a name that the prompt doesn't hold.

    A sentence declines by its wording or, the first or the last one, by the model.
    """
    text = response.replace("’", "'")
    if not _QUOTE_MARKS.isdisjoint(text):
        text = _QUOTE.sub(" ", text)
    if not CUE.search(text.lower()):
        return False
    worded = _REFUSALS.search(text.lower())
    if not worded and model is None:
        return False
    sentences = [s for s in _SENTENCE.split(text) if s.strip()]
    if not worded and not any(map(model.declines, {*sentences[:1], *sentences[-1:]})):
        return False
    for i, s in enumerate(sentences):
        if _REFUSALS.search(s.lower()) if i == 0 else _REFUSALS.search(" " + s.lower(), 1):
            return True
        if model and i in (0, len(sentences) - 1) and model.declines(s):
            return True
        if any(x not in prompt for x in _ANSWERS.findall(_ADDRESS.sub(" ", s))):
            return False
    return bool(worded)


def is_truncated(response: str, end_share: float | None) -> bool:
    """end_share: of the occurrences of the last characters those at an end; None if there are too few."""
    text = response.rstrip()
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    if not _BRACKETS.isdisjoint(text):
        plain = re.sub(r"[:;][-']?[)(]", "", _QUOTE.sub("", text))
        if any(plain.count(a) > plain.count(b) for a, b in ("()", "[]", "{}", "（）", "「」", "『』", "«»")):
            return True
    if text[-1:] in ",;:、，；：(-–—":
        return True
    items = _ITEM.findall(text)
    if items and _BARE_MARKER.search(text):
        return True
    if items and _ITEM.match("\n" + text[text.rfind("\n") + 1 :]) and not _FINAL.search(text):
        if end_share is not None:
            return end_share < END_SHARE
        *others, last = items
        return bool(others) and all(map(_FINAL.search, others)) or len(last.split()) > 1 and last.split()[-1].lower() in LINKS
    if end_share is not None and end_share < END_SHARE:
        return True
    if _FINAL.search(text):
        return False
    body = bare(text)
    dense = any(ord(c) > 0x2E80 for c in body)
    return len(body) > (12 if dense else 30) and (bool(re.search(r"[.!?。！？:：] ?\S", text)) or len(text.split()) > 6 or dense)


def foreign(prompt: str, response: str, languages: Languages) -> bool:
    """Whether the response, without a repeated prompt, is in a language that is neither the prompt's nor asked for."""
    asked = prompt.lower()
    own = response.replace(prompt, " ").replace(prompt.rstrip("?!.。？！ "), " ")
    p, r = languages.posterior(prompt), languages.posterior(own)
    if p is None or r is None or p[0] == r[0] or p[1] < 6 or r[1] < 6:
        return False
    return not any(re.search(rf"(?<![^\W_]){re.escape(n)}" if n.isascii() else re.escape(n), asked) for n in LANGUAGE_NAMES.get(r[0], r[0]).split())


def defect(prompt: str | None, response: str | None, end_share: float | None, languages: Languages, refusals: Refusals | None = None) -> str | None:
    if is_empty(response):
        return "empty"
    prompt = prompt or ""
    if is_echo(prompt, response):
        return "echo"
    if is_refusal(response, prompt, refusals):
        return "refusal"
    if foreign(prompt, response, languages):
        return "language"
    return "truncated" if is_truncated(response, end_share) else None


def fit_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> Languages:
    """The classifier, from whole labelled documents: of each language ``sample_docs`` and ``sample_chars`` at most.

    A label is a code of two or three letters, regions aside. Of more than ``languages`` those with the fewest documents are unknown.
    """
    code = F.regexp_extract(F.lower(F.trim(lang_col)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    rows = docs.select(code.alias("l"), F.col(text_col).alias("t"), F.xxhash64(id_col).alias("h")).where("l <> '' and t <> ''")
    ranked = rows.selectExpr("l", "t", "row_number() over (partition by l order by h) as r").where(f"r <= {sample_docs}")
    taken = ranked.selectExpr("l", "t", "sum(length(t)) over (partition by l order by r) - length(t) as before").where(f"before < {sample_chars}")
    by = taken.groupBy("l").agg(F.collect_list("t").alias("t")).orderBy(F.desc(F.size("t")), "l").limit(languages)
    return Languages({x["l"]: x["t"] for x in by.collect()})


def fit_refusals(pairs: DataFrame, id_col: str, response_col: str, sample: int = SAMPLE_RESPONSES) -> Refusals:
    """The model of refusals; ``sample`` responses at most count as answers, but for those whose wording declines."""
    rows = pairs.select(F.col(response_col).alias("t"), F.xxhash64(id_col).alias("h")).where("t <> ''").orderBy("h").limit(sample)
    texts = [r["t"] for r in rows.collect()]
    return Refusals(s for t in texts if not is_refusal(t) for s in _SENTENCE.split(t) if s.strip())


def _ending(masked: Column, n: int) -> Column:
    """The last ``n`` characters; marked \\x03 if they end an item without an end mark, the whole item, marked \\x04, if it is one word."""
    plain = F.when(F.length(masked) < n, F.concat(F.lit("\x02"), masked)).otherwise(F.right(masked, F.lit(n)))
    item = F.regexp_extract(masked, _MARKER + r" ([^\n]*)$", 1)
    short = ~item.rlike(r"[\s\p{Z}]|" + _DENSE.pattern)
    marked = F.when(short, F.concat(F.lit("\x04"), item)).otherwise(F.concat(F.lit("\x03"), plain))
    return F.when((item != "") & ~item.rlike(_FINAL.pattern), marked).otherwise(plain)


def _counted(n: int, wanted, listed):
    """(gram, seen, ended) of all substrings of ``n`` characters and, marked as such, shorter beginnings; if wanted, only of these.

    Likewise of those marked as endings and beginnings of items, if listed only of these; only for them ``ended`` is counted.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        ended: Counter = Counter()
        only = wanted.value if wanted else None
        items = listed.value if listed else None
        table = lambda: pd.DataFrame({"gram": list(seen.keys()), "seen": list(seen.values()), "ended": [ended[g] for g in seen]})
        for b in batches:
            for t, times in b["masked"].value_counts().items():
                grams = [*(t[i : i + n] for i in range(len(t) - n + 1)), *("\x02" + t[:i] for i in range(1, min(n, len(t) + 1)))]
                for g in grams:
                    if only is None or g in only:
                        seen[g] += times
                if items is None or items:
                    whole = max(0, len(t) - n + 1)
                    for i, g in enumerate(grams):
                        if items is None or "\x03" + g in items:
                            seen["\x03" + g] += times
                            end = i + n if i < whole else i - whole + 1
                            if end == len(t) or t[end] in _AFTER_END:
                                ended["\x03" + g] += times
                    for x in map(str.rstrip, _ITEM.findall(t)):
                        for i in range(1, len(x.split(None, 1)[0]) + 1 if x else 0):
                            if items is None or "\x04" + x[:i] in items:
                                seen["\x04" + x[:i]] += times
                                if i == len(x):
                                    ended["\x04" + x] += times
            if len(seen) > 300_000:
                yield table()
                seen.clear()
                ended.clear()
        if seen:
            yield table()

    return scan


def end_shares(texts: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(gram, seen, share) of the endings of ``n`` characters that some text of ``masked`` has, over all texts; their number."""
    ends = materialize(texts.select(_ending(F.col("masked"), n).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("ends")))
    of_item = F.col("gram").rlike("^[\x03\x04]")
    number, few = ends.count(), ends.where(of_item).count()
    sets = [(number - few, ends.where(~of_item)), (few, ends.where(of_item))]
    wanted, listed = (texts.sparkSession.sparkContext.broadcast({r[0] for r in e.select("gram").collect()}) if k * 120 <= BROADCAST_BYTES else None for k, e in sets)
    seen = texts.mapInPandas(_counted(n, wanted, listed), "gram string, seen long, ended long").groupBy("gram").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    return ends.join(seen, "gram").select("gram", "seen", (F.when(of_item, F.col("ended")).otherwise(F.col("ends")) / F.col("seen")).alias("share")), number


def defective_pairs(pairs: DataFrame, id_col: str, prompt_col: str, response_col: str, languages: Languages, refusals: Refusals | None = None) -> DataFrame:
    """(id, defect): the defective pairs, each once, with one of empty, echo, refusal, language, truncated, in this order.

    A null prompt echoes nothing and has no language; a null response is empty; rows with a null id are left out; an id
    that is delivered more than once counts once; an empty table gives no rows.
    """
    rows = spread(pairs.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response")).where("id is not null"))
    masked = F.regexp_replace(F.regexp_replace("response", r"[\s\p{Z}]+$", ""), r"\p{N}", "9")
    rows = rows.withColumn("masked", F.coalesce(masked, F.lit("")))
    texts = rows.select("masked").where("masked <> ''")
    out, shares = rows, []
    for n in ENDINGS:
        table, number = end_shares(texts, n)
        stats = materialize(table.where(F.col("seen") >= SUPPORT).select(F.col("gram").alias(f"g{n}"), F.col("share").alias(f"s{n}")))
        out = out.withColumn(f"g{n}", _ending(F.col("masked"), n)).join(broadcast_if(stats, number, 120), f"g{n}", "left")
        shares.append(F.col(f"s{n}"))
    known = pairs.sparkSession.sparkContext.broadcast((languages, refusals))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["defect"] = [defect(p, r, None if s != s else s, *known.value) for p, r, s in zip(b["prompt"], b["response"], b["share"])]
            yield b.loc[b["defect"].notna(), ["id", "defect"]]

    kind = dict(rows.dtypes)["id"]
    judged = out.select("id", "prompt", "response", F.coalesce(*shares).alias("share")).mapInPandas(judge, f"id {kind}, defect string")
    return judged.dropDuplicates(["id"])


def p5_defects(hits: DataFrame, docs: DataFrame) -> DataFrame:
    return defective_pairs(hits, "hit_id", "prompt", "response", fit_languages(docs, "doc_id", "text", "lang"), fit_refusals(hits, "hit_id", "response"))
