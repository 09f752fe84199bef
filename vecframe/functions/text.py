"""Text analysis as columns: words, word predicates and BM25, in string expressions that stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default stopwords.
STOPWORDS = "a is the an and are as at be but by for if in into it no not of on or such that their then there these they this to was will with".split()
K1, B = 1.2, 0.75
_BETWEEN = r"[^\p{L}\p{N}_]+"


def words(c: Column) -> Column:
    """The lower-case words of letters, digits and ``_``, each followed and preceded by one space."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(c), _BETWEEN, " ")), F.lit(" "))


def analyze(text: str, stopwords: tuple[str, ...] | None = ()) -> list[str]:
    """The words of a query string. stopwords: () for none, None for the default list."""
    import regex

    drop = set(STOPWORDS if stopwords is None else [w.lower() for w in stopwords])
    return [w for w in regex.split(_BETWEEN, text.lower()) if w and w not in drop]


# predicates over the words of a text, as words() gives them


def _piece(text: str) -> str:
    """A piece of a text as the words stand there: lower case, one space for all between two words."""
    import regex

    return regex.sub(_BETWEEN, " ", text.lower())


def has_prefix(w: Column, prefix: str) -> Column:
    """Words of which the last begins so; ``neo-no`` is the word ``neo`` and one that begins with ``no``."""
    p = _piece(prefix)
    return w.contains(" " + p.lstrip()) if p.strip() else F.lit(False)


def has_suffix(w: Column, suffix: str) -> Column:
    p = _piece(suffix)
    return w.contains(p.rstrip() + " ") if p.strip() else F.lit(False)


def has_infix(w: Column, infix: str) -> Column:
    p = _piece(infix)
    return w.contains(p) if p.strip() else F.lit(False)


def has_fuzzy(w: Column, term: str, distance: int) -> Column:
    return F.exists(F.split(F.btrim(w), " "), lambda x: F.levenshtein(x, F.lit(term.lower()), distance) >= 0)


def has_phrase(w: Column, phrase: str) -> Column:
    """The words of ``phrase`` side by side; a phrase without words matches nothing."""
    parts = analyze(phrase)
    return w.contains(f" {' '.join(parts)} ") if parts else F.lit(False)


def word_count(w: Column) -> Column:
    return F.when(F.length(w) < 3, 0).otherwise(F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit(""))) - 1)


def term_count(w: Column, term: str) -> Column:
    """How often a word occurs; spaces are doubled first, so that neighbours don't share one."""
    wide, alone = F.replace(w, F.lit(" "), F.lit("  ")), f" {term} "
    return ((F.length(wide) - F.length(F.replace(wide, F.lit(alone), F.lit("")))) / len(alone)).cast("double")


def corpus_statistics(df: DataFrame, fields: list[str], terms: list[str]) -> tuple[int, dict[str, float], dict[tuple[str, str], int]]:
    """Documents, average length of each field, and document frequency of each (field, term), in one aggregation."""
    rows = df.select(*[words(F.col(f)).alias(f"_w{i}") for i, f in enumerate(fields)])
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.avg(F.coalesce(word_count(F.col(f"_w{i}")), F.lit(0))).alias(f"l{i}") for i in range(len(fields))]
    sums += [F.count(F.when(F.col(f"_w{i}").contains(f" {t} "), 1)).alias(f"d{i}_{j}") for i in range(len(fields)) for j, t in enumerate(terms)]
    row = rows.agg(*sums).first()
    return row["n"], {f: row[f"l{i}"] or 0.0 for i, f in enumerate(fields)}, {(f, t): row[f"d{i}_{j}"] for i, f in enumerate(fields) for j, t in enumerate(terms)}


def scored(rows: DataFrame, corpus: DataFrame, weights: dict[str, float], terms: list[str], alias: str = "_score", k1: float = K1, b: float = B, clamp: bool = False) -> DataFrame:
    """``rows`` with the BM25 score of ``terms`` over the weighted text fields; the statistics are those of ``corpus``."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    if not terms or not weights:
        return rows.withColumn(alias, F.lit(0.0))
    n, lengths, df_of = corpus_statistics(corpus, list(weights), terms)
    names = {f: f"_w{i}" for i, f in enumerate(weights)}
    score = F.lit(0.0)
    for f, weight in weights.items():
        w = F.col(names[f])
        norm = 1 - b + b * F.coalesce(word_count(w), F.lit(0)) / F.lit(lengths[f] or 1.0)
        for t in terms:
            d = df_of[f, t]
            tf = term_count(w, t)
            tf = F.coalesce(F.least(tf, F.lit(1.0)) if clamp else tf, F.lit(0.0))
            score = score + F.lit(weight * math.log(1 + (n - d + 0.5) / (d + 0.5))) * tf * (k1 + 1) / (tf + k1 * norm)
    return rows.withColumns({names[f]: words(F.col(f)) for f in weights}).withColumn(alias, score).drop(*names.values())
