"""Rerankers: the contract, a lexical one, a local cross-encoder, a hosted one, and a DataFrame adapter."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecframe.runtime import numbered
from vecframe.functions.text import analyze
from vecframe.vectorizers import Post, http_post


@dataclass(frozen=True)
class RerankDocument:
    text: str
    id: str | None = None
    metadata: Any = None

    def __post_init__(self) -> None:
        if not isinstance(self.text, str) or not self.text.strip():
            raise ValueError("a document's text must not be blank")


@dataclass(frozen=True)
class RerankRequest:
    query: str
    documents: tuple[RerankDocument, ...]
    top_n: int | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.query, str) or not self.query.strip():
            raise ValueError("the query must not be blank")
        if self.top_n is not None and self.top_n <= 0:
            raise ValueError("top_n must be positive")
        object.__setattr__(self, "documents", tuple(d if isinstance(d, RerankDocument) else RerankDocument(d) for d in self.documents))


@dataclass(frozen=True)
class RerankResult:
    index: int
    score: float
    document: RerankDocument

    def __post_init__(self) -> None:
        if self.index < 0:
            raise ValueError("an index must not be negative")


class Reranker(Protocol):
    def rerank(self, request: RerankRequest) -> list[RerankResult]: ...


def ranked(request: RerankRequest, scores: Sequence[float], threshold: float | None = None) -> list[RerankResult]:
    """Results by falling score, equal ones in the order given; those below the threshold are left out."""
    rows = [RerankResult(i, float(s), d) for i, (s, d) in enumerate(zip(scores, request.documents)) if threshold is None or s >= threshold]
    return sorted(rows, key=lambda r: (-r.score, r.index))[: request.top_n]


def lexical_score(query: str, text: str) -> float:
    """The share of the query's words that the text holds."""
    wanted = set(analyze(query))
    return len(wanted & set(analyze(text))) / len(wanted) if wanted else 0.0


class LexicalReranker:
    def rerank(self, request: RerankRequest) -> list[RerankResult]:
        return ranked(request, [lexical_score(request.query, d.text) for d in request.documents])


class WordPieceTokenizer:
    """Pairs of texts as word pieces: ``[CLS] a [SEP] b [SEP]`` with types 0 and 1, the longer side cut first."""

    def __init__(self, vocabulary: dict[str, int], lower: bool = True, max_length: int = 512, piece: str = "##", longest_word: int = 100) -> None:
        if max_length < 3:
            raise ValueError("max_length must be 3 at least")
        missing = [t for t in ("[CLS]", "[SEP]", "[UNK]") if t not in vocabulary]
        if missing:
            raise ValueError(f"the vocabulary lacks {', '.join(missing)}")
        self.vocabulary, self.lower, self.max_length, self.piece, self.longest_word = vocabulary, lower, max_length, piece, longest_word

    @classmethod
    def from_file(cls, path: str, **options: Any) -> WordPieceTokenizer:
        """From a ``tokenizer.json`` with a WordPiece model, or a vocabulary of a piece a line."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if text.lstrip().startswith("{"):
            whole = json.loads(text)
            model = whole["model"]
            if model.get("type") not in (None, "WordPiece"):
                raise ValueError(f"unsupported model: {model.get('type')}")
            normalizer = whole.get("normalizer") or {}
            return cls(model["vocab"], **{"lower": bool(normalizer.get("lowercase", True)), "piece": model.get("continuing_subword_prefix", "##")} | options)
        return cls({w: i for i, w in enumerate(text.splitlines())}, **options)

    def basic(self, text: str) -> list[str]:
        out = []
        for c in text:
            kind = unicodedata.category(c)
            if c in "\0�" or (kind in ("Cc", "Cf") and c not in "\t\n\r"):
                continue
            out.append(f" {c} " if 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0xF900 <= ord(c) <= 0xFAFF or 0x20000 <= ord(c) <= 0x2FA1F else " " if c.isspace() else c)
        t = "".join(out)
        if self.lower:
            t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
        marks = lambda c: unicodedata.category(c)[0] == "P" or (ord(c) < 128 and not c.isalnum() and not c.isspace())
        return "".join(f" {c} " if marks(c) else c for c in t).split()

    def pieces(self, word: str) -> list[int]:
        """Greedy longest pieces of a word, or the unknown piece."""
        unknown = [self.vocabulary["[UNK]"]]
        if len(word) > self.longest_word:
            return unknown
        out, start = [], 0
        while start < len(word):
            end = next((e for e in range(len(word), start, -1) if (self.piece if start else "") + word[start:e] in self.vocabulary), 0)
            if not end:
                return unknown
            out.append(self.vocabulary[(self.piece if start else "") + word[start:end]])
            start = end
        return out

    def encode(self, a: str, b: str) -> tuple[list[int], list[int], list[int]]:
        """Ids, attention mask and types of a pair."""
        x, y = ([i for w in self.basic(t) for i in self.pieces(w)] for t in (a, b))
        room = self.max_length - 3
        while len(x) + len(y) > room:
            (x if len(x) > len(y) else y).pop()
        cls_, sep = self.vocabulary["[CLS]"], self.vocabulary["[SEP]"]
        ids = [cls_, *x, sep, *y, sep]
        return ids, [1] * len(ids), [0] * (len(x) + 2) + [1] * (len(y) + 1)


class OnnxScorer:
    """A cross-encoder in an ONNX file: needs ``input_ids``, takes mask and types if it has them, gives one number."""

    def __init__(self, path: str) -> None:
        self.path, self._session = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_session": None}

    def __call__(self, ids: list[int], mask: list[int], kinds: list[int]) -> float:
        return self.batch([(ids, mask, kinds)])[0]

    def batch(self, pairs: list[tuple[list[int], list[int], list[int]]]) -> list[float]:
        """The scores of several pairs in one call of the model, the shorter ones padded and masked."""
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        inputs = {i.name: i.type for i in self._session.get_inputs()}
        if "input_ids" not in inputs:
            raise ValueError("the model has no input_ids")
        width = max(len(ids) for ids, _, _ in pairs)
        padded = [[x + [0] * (width - len(x)) for x in column] for column in zip(*pairs)]
        values = dict(zip(("input_ids", "attention_mask", "token_type_ids"), padded))
        feed = {n: np.array(values[n], np.int32 if inputs[n] == "tensor(int32)" else np.int64) for n in inputs if n in values}
        out = np.asarray(self._session.run(None, feed)[0])
        if out.size != len(pairs):
            raise ValueError(f"{len(pairs)} scores were expected, not {out.size}")
        return out.reshape(-1).astype(float).tolist()


class CrossEncoderReranker:
    """Scores (query, document) pairs with a local model, in batches of pairs of like length if it takes these."""

    def __init__(self, tokenizer: WordPieceTokenizer, scorer: Callable[[list[int], list[int], list[int]], float], threshold: float | None = None, batch_size: int = 32) -> None:
        self.tokenizer, self.scorer, self.threshold, self.batch_size = tokenizer, scorer, threshold, batch_size

    def rerank(self, request: RerankRequest) -> list[RerankResult]:
        return ranked(request, self.scores(request.query, [d.text for d in request.documents]), self.threshold)

    def scores(self, query: str, texts: list[str]) -> list[float]:
        pairs = [self.tokenizer.encode(query, t) for t in texts]
        if not hasattr(self.scorer, "batch"):
            return [self.scorer(*p) for p in pairs]
        out = [0.0] * len(pairs)
        order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]))
        for i in range(0, len(order), self.batch_size):
            some = order[i : i + self.batch_size]
            for at, score in zip(some, self.scorer.batch([pairs[x] for x in some])):
                out[at] = score
        return out


class HostedReranker:
    """A hosted service with a rerank request: model, query, documents and top_n; its order is kept."""

    def __init__(self, url: str, api_key: str, model: str, max_tokens_per_doc: int | None = None, priority: int | None = None, post: Post = http_post) -> None:
        if priority is not None and not 0 <= priority <= 999:
            raise ValueError("a priority lies between 0 and 999")
        self.url, self.api_key, self.model, self.post = url, api_key, model, post
        self.options = {k: v for k, v in (("max_tokens_per_doc", max_tokens_per_doc), ("priority", priority)) if v is not None}

    def rerank(self, request: RerankRequest) -> list[RerankResult]:
        if not request.documents:
            return []
        body = {"model": self.model, "query": request.query, "documents": [d.text for d in request.documents]} | self.options
        if request.top_n is not None:
            body["top_n"] = request.top_n
        out = []
        for r in self.post(self.url, {"Authorization": f"Bearer {self.api_key}"}, body)["results"]:
            if not 0 <= r["index"] < len(request.documents):
                raise ValueError(f"no document {r['index']}")
            out.append(RerankResult(r["index"], float(r["relevance_score"]), request.documents[r["index"]]))
        return out


def score_column(query: str, text: Column, score: Callable[[str, str], float]) -> Column:
    """``score(query, text)`` of each row, in Arrow batches; null of a null text."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda t: None if t is None else score(query, t)).astype("float64")

    return run(text)


def rerank_frame(df: DataFrame, score: Column, ties: str, top_n: int | None = None, groups: list[str] | None = None, threshold: float | None = None) -> DataFrame:
    """Rows with ``score`` and ``rank``, best first, of the whole table or of each group."""
    rows = df.withColumn("score", score)
    rows = rows.where(F.col("score").isNotNull() if threshold is None else F.col("score") >= threshold)
    best = [F.desc("score"), F.col(ties)]
    if not groups:  # numbered over all partitions, for a window over the whole table is one task
        if top_n is not None:
            rows = rows.orderBy(*best).limit(top_n)
        return numbered(rows.orderBy(*best), "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    order = Window.partitionBy(*groups).orderBy(*best)
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if top_n is None else out.where(F.col("rank") <= top_n)
