"""Language identification by words first, then by shorter and shorter character n-grams.

A word that the training rows know counts with its log frequency in each language. An unseen word falls back
to those of its n-grams that are known, at the greatest length (``MAX_GRAM`` down to one character) at which any
is known; they count with the mean of their log frequencies. A word is a letter and the letters and marks behind
it. A text's languages are compared by the sum over its words; ``score`` is the share of the best one after the sum
has been flattened by ``TEMPERATURE``.

Learning takes a bounded sample of every language that the labels name: ``sample_rows`` rows of each, or all where it
has fewer, chosen by a hash of key and text; with more than ``most_rows // sample_rows`` languages, each gets its even
share of ``most_rows``. All words and n-grams of the sample are learned, also those that occur once. Spark counts them; the
counts reach the driver and the executors, so what those hold grows with the sample and not with the corpus.

Defined results: a null text, a text without letters, and any text when nothing has been learned give ``und``
with score 0; ties go to the language with more labelled rows, then to the first by name; rows with a null
label are not learned from, and rows that repeat key, label and text teach once; repeated rows get equal results;
columns with the names of results are replaced, others of any name are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.arrow import Numbers, encoded, slices
from evispark.llm.columns import at, by_place, named

SAMPLE_ROWS, MOST_ROWS = 1_000, 20_000
MAX_GRAM = 5
UNKNOWN = "und"
#: Evidence is divided by the words' number to this power: neighbouring words aren't independent.
TEMPERATURE = 0.5
#: Bytes of text taken together; numbers (a token's sums by language) that a task remembers.
CALL, MEMORY = 4_000_000, 2_000_000
WORD = r"\p{L}[\p{L}\p{M}]*"
WORDS = regex.compile(WORD)


@dataclass
class Model:
    """items: the number of each word (marked by a space) and n-gram; first: where an item's entries begin in language
    and gain, which is what its count adds to the log frequency of an unseen item; floors: that of each kind of item (0
    for words, n for n-grams) by language; prior: the log share of each language's rows."""

    languages: list[str]
    items: dict[str, int]
    first: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    floors: np.ndarray
    prior: np.ndarray


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, most_rows: int = MOST_ROWS) -> Model:
    """A model of the labelled rows; rows without text or label teach nothing."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL AND lang IS NOT NULL")
    of = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(of)
    if not names:
        return model_of([], [], [], {})
    sample_rows = min(sample_rows, max(1, most_rows // len(names)))
    shares = spark.createDataFrame([(name, int(min(1.0, sample_rows / of[name]) * (1 << 30))) for name in names], "lang string, share long")
    drawn = rows.withColumn("h", F.xxhash64("key", "text")).join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share"))
    drawn = drawn.dropDuplicates(["lang", "h"]).repartition(spark.sparkContext.defaultParallelism)
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("item"))
    counts = words.groupBy("lang", "item").agg(F.count("*").alias("n")).persist()
    try:
        known = counts.toPandas()
        marked = F.concat(F.lit("^"), "item", F.lit("$"))
        grams = F.flatten(F.array(*[gram_list(marked, n) for n in range(1, MAX_GRAM + 1)]))
        pieces = counts.select("lang", "n", F.explode(grams).alias("item")).groupBy("lang", "item").agg(F.sum("n").alias("n"))
        short = pieces.toPandas()
    finally:
        counts.unpersist()
    entries = [(f" {w}", lang, n) for w, lang, n in zip(known["item"], known["lang"], known["n"])]
    return model_of(names, entries, list(zip(short["item"], short["lang"], short["n"])), of)


def model_of(names: list[str], words: list[tuple], grams: list[tuple], rows: dict[str, int]) -> Model:
    """words and grams: (item, language, count), words with a space in front."""
    entries = sorted(words + grams)
    items: dict[str, int] = {}
    number = np.array([items.setdefault(e[0], len(items)) for e in entries], np.int64)
    place = {name: k for k, name in enumerate(names)}
    language = np.array([place[e[1]] for e in entries], np.int64)
    count = np.array([e[2] for e in entries], np.float64)
    kind_of = np.array([0 if i[0] == " " else len(i) for i in items], np.int64)
    total = np.zeros((MAX_GRAM + 1, len(names)))
    np.add.at(total, (kind_of[number], language), count)
    different = np.bincount(kind_of, minlength=MAX_GRAM + 1)
    floors = np.log(0.5 / (total + 0.5 * np.maximum(1, different)[:, None]))  # half an occurrence more of every item
    share = np.array([rows[name] for name in names], np.float64)
    return Model(names, items, np.searchsorted(number, np.arange(len(items) + 1)), language, np.log((count + 0.5) / 0.5), floors, np.log(share / share.sum()) if names else share)


def gram_list(word: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word) - n + 1, F.lit(1))), lambda i: word.substr(i, F.lit(n)))


class Scorer:
    """Sums of log frequencies of texts; each different token is looked up once."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.numbers = Numbers(max(1_000, MEMORY // max(1, len(self.model.languages))))
        self.sums = np.zeros((0, len(self.model.languages)), np.float32)
        self.runs = np.zeros(0, np.int32)

    def items_of(self, word: str) -> tuple[int, list[int]]:
        """The kind and the numbers of the items that speak for a word."""
        items = self.model.items
        if (known := items.get(f" {word}")) is not None:
            return 0, [known]
        marked = f"^{word}$"
        for n in range(min(MAX_GRAM, len(marked)), 0, -1):
            found = [items[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in items]
            if found:
                return n, found
        return 0, []

    def learn(self, tokens: list[bytes]) -> None:
        flat, weights, owner, runs = [], [], [], []
        kinds = np.zeros((len(tokens), MAX_GRAM + 1))
        for k, t in enumerate(tokens):
            words = WORDS.findall(t.decode().lower())
            runs.append(len(words))
            for w in words:
                kind, found = self.items_of(w)
                if found:
                    kinds[k, kind] += 1
                    flat += found
                    weights += [1 / len(found)] * len(found)
                    owner += [k] * len(found)
        model, flat = self.model, np.array(flat, np.int64)
        size = model.first[flat + 1] - model.first[flat]
        entry = np.arange(int(size.sum())) + np.repeat(model.first[flat] - np.cumsum(size) + size, size)
        sums = kinds @ model.floors
        np.add.at(sums, (np.repeat(np.array(owner, np.int64), size), model.language[entry]), model.gain[entry] * np.repeat(weights, size))
        self.sums = np.concatenate([self.sums, sums.astype(np.float32)])
        self.runs = np.concatenate([self.runs, np.array(runs, np.int32)])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums by language, and numbers of words."""
        if self.numbers.full():
            self.reset()
        split = [t.split() for t in texts]
        at, new = self.numbers(list(chain.from_iterable(split)))
        if new:
            self.learn(new)
        doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
        sums = np.stack([np.bincount(doc, self.sums[at, k], len(texts)) for k in range(self.sums.shape[1])], axis=1)
        return sums, np.bincount(doc, self.runs[at], len(texts))


def language(text: Column, model: Model) -> Column:
    """struct of lang_pred and score."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer, names = Scorer(model), np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            texts, pred, score = encoded(batch), [], []
            for a, b in slices(list(map(len, texts)), CALL):
                if model.languages:
                    sums, n = scorer(texts[a:b])
                    flat = (sums + model.prior) / np.maximum(n, 1)[:, None] ** TEMPERATURE
                    best = np.argmax(sums + model.prior, axis=1)
                    share = 1 / np.exp(flat - flat.max(1, keepdims=True)).sum(1)
                    heard = n > 0
                    pred += names[np.where(heard, best, len(names) - 1)].tolist()
                    score += np.where(heard, share, 0.0).tolist()
                else:
                    pred += [UNKNOWN] * (b - a)
                    score += [0.0] * (b - a)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row."""
    found = by_place(docs).withColumn("found", language(at(docs, text), model)).withColumns({"lang_pred": F.col("found.lang_pred"), "score": F.col("found.score")})
    return found.select(*named(docs, ["lang_pred", "score"]))
