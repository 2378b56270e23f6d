"""Language ID, words first: per-language log frequencies, n-grams for unseen words.

Training counts words by language over a bounded sample of labelled documents
(about ``per_language`` of each, chosen by a hash of the id) and keeps the most
frequent words and character n-grams, so that the model has a bounded size and
may be broadcast.  A word in the model adds its log frequency in every
language.  Any other word adds the mean over its longest n-grams that the model
knows: all those of the longest order with at least one hit.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.joins import join_side
from radloom.llm.common import packed, stored

#: Runs of letters (and what else \\w holds but digits and underscores), lower-cased.
TOKEN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageOptions:
    """``per_language``, ``languages`` (the most frequent ones), ``words`` and ``grams`` bound the sample and the model."""

    per_language: int = 1_000
    languages: int = 200
    words: int = 50_000
    grams: int = 30_000
    longest: int = 5
    smoothing: float = 0.5
    #: Words kept in a Python worker's cache of scores before it starts anew.
    cache: int = 400_000


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    words: dict[str, int]
    grams: dict[str, int]
    scores: list[tuple[float, ...]]    # a row per word or n-gram


def pieces(word: str, n: int) -> list[str]:
    """Character n-grams of a word between boundary marks."""
    framed = f"<{word}>"
    return [framed[i:i + n] for i in range(len(framed) - n + 1)] if n > 1 else list(word)


def held_out(key: Column) -> Column:
    """Documents that are never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sample(df: DataFrame, key: str, text: str, lang: str, options: LanguageOptions) -> DataFrame:
    """Labelled rows whose uniform hash is below their language's share."""
    known = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(options.languages).collect()
    if not counts:
        return known.select("text", "lang").limit(0)
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], options.per_language / r["count"])])
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit("language sample"), "key"), 11) / F.lit(float(1 << 53))
    return known.where(uniform < F.try_element_at(shares, F.col("lang"))).select("text", "lang")


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", options: LanguageOptions | None = None) -> LanguageModel:
    """Fit the model on rows that are not held out and have text and lang; other columns are not read."""
    options = options or LanguageOptions()

    def tokens(batches):
        for batch in batches:
            out: dict[str, Counter] = {}
            for body, label in zip(batch["text"], batch["lang"]):
                out.setdefault(label, Counter()).update(TOKEN.findall(body.lower()))
            yield pd.DataFrame([(label, w, n) for label, c in out.items() for w, n in c.items()], columns=["lang", "word", "n"]).astype({"n": "int64"})

    def grams(batches):
        for batch in batches:
            out: dict[tuple[str, str], int] = {}
            for label, word, n in zip(batch["lang"], batch["word"], batch["n"]):
                for size in range(1, options.longest + 1):
                    for gram in pieces(word, size):
                        out[label, gram] = out.get((label, gram), 0) + n
            yield pd.DataFrame([(k[0], k[1], v) for k, v in out.items()], columns=["lang", "gram", "n"]).astype({"n": "int64"})

    words = stored(_sample(df, key, text, lang, options).mapInPandas(tokens, "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    found = stored(words.mapInPandas(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))

    def frequent(counts: DataFrame, name: str, limit: int) -> pd.DataFrame:
        top = counts.groupBy(name).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), name).limit(limit).select(F.col(name).alias("entry"))
        return counts.join(join_side(top, "entry"), F.col(name) == F.col("entry")).select("lang", "entry", "n").toPandas()

    return build(frequent(words, "word", options.words), frequent(found, "gram", options.grams), options)


def build(words: pd.DataFrame, grams: pd.DataFrame, options: LanguageOptions) -> LanguageModel:
    """Smoothed log frequencies; an n-gram's are among the n-grams of its length."""
    languages = tuple(sorted(set(words["lang"])))
    place = {x: i for i, x in enumerate(languages)}
    scores: list[tuple[float, ...]] = []

    def add(table: pd.DataFrame) -> dict[str, int]:
        entries = sorted(set(table["entry"]))
        row = {e: i for i, e in enumerate(entries)}
        counts = np.full((len(entries), len(languages)), options.smoothing)
        np.add.at(counts, (table["entry"].map(row).to_numpy(dtype=int), table["lang"].map(place).to_numpy(dtype=int)), table["n"].to_numpy(dtype=float))
        first = len(scores)
        scores.extend(map(tuple, np.log(counts / counts.sum(axis=0)).tolist()))
        return {e: first + i for i, e in enumerate(entries)}

    known: dict[str, int] = {}
    for n in range(1, options.longest + 1):
        known.update(add(grams[grams["entry"].str.len() == n]))
    return LanguageModel(languages, add(words), known, scores)


class Scorer:
    """Predicts one text at a time; remembers the words it has met."""

    def __init__(self, model: LanguageModel, options: LanguageOptions):
        self.model, self.options = model, options
        self.places: dict[str, int] = {}
        self.table = np.zeros((options.cache, len(model.languages)))

    def word(self, word: str) -> tuple[float, ...]:
        model = self.model
        if word in model.words:
            return model.scores[model.words[word]]
        for n in range(self.options.longest, 0, -1):
            hits = [model.scores[model.grams[p]] for p in pieces(word, n) if p in model.grams]
            if hits:
                return tuple([sum(column) / len(hits) for column in zip(*hits)])
        return (0.0,) * len(model.languages)

    def _total(self, words: list[str]) -> np.ndarray:
        places = self.places
        total = np.zeros(len(self.model.languages))
        for part in range(0, len(words), self.options.cache):  # so many words fit in the table at least
            some = words[part:part + self.options.cache]
            new = [w for w in dict.fromkeys(some) if w not in places]
            if len(places) + len(new) > self.options.cache:
                places.clear()
                new = list(dict.fromkeys(some))
            for w in new:
                self.table[len(places)] = self.word(w)
                places[w] = len(places)
            total += self.table[[places[w] for w in some]].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = TOKEN.findall(text.lower()) if text else []
        if not self.model.languages or not any(any(map(str.isalpha, w)) for w in words):
            return UNKNOWN, 0.0
        total = self._total(words)
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return self.model.languages[best], float(odds[best] / odds.sum())


def identify(df: DataFrame, model: LanguageModel, text: str = "text", options: LanguageOptions | None = None) -> DataFrame:
    """``row`` (the input row), ``lang_pred`` and ``score``, the posterior (0 to 1) under equal priors.

    Whole texts are scored, from the text alone.  ``und`` with score 0 is given
    to null texts, to texts without a letter, and to all if nothing was learned.  A text of
    letters the model has never met gets the first language, at an even score.
    Equal scores go to the smallest name.  Rows are independent.
    """
    options = options or LanguageOptions()
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value, options)
        for texts in batches:
            yield pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang_pred", "score"])

    return packed(df).select("row", predict(F.col("row")[text]).alias("p")).select("row", "p.lang_pred", "p.score")
