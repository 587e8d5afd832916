"""Toxicity of texts: a learned weighted lexicon, matched by Aho-Corasick on folded text.

Method: texts are folded (letters that look alike, and digits or signs standing for
letters before a letter, become the plain letter; A-Z lower-cased; punctuation becomes
one space). The lexicon holds whole words and word beginnings of 3 to 7 letters whose
document counts differ clearly between toxic and clean labelled texts, with their log
odds as weights. Phrases of a lexicon word and its neighbour that clean texts use are
exceptions: a hit inside one does not count. A text's score is a logistic function of
the weight of its hits and of that weight per hundred words.

Learning uses at most `most` labelled rows (those with the least hash), never the
held-out ones; three quarters of them give the lexicon, the rest the logistic curve.

Rows: a null or empty text has no hits. Rows without a doc_id are held out. With no
usable labels the lexicon is empty and every score is 0. Repeated training texts
count once. The model is bounded by `most_terms`, so it can be broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.llm.textkit import slices
from perdura.sources.staging import stage_table

# fixed values: letters of other scripts that look like Latin ones, and signs used for letters
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "ё": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "д": "d", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l",
})
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
BEFORE_LETTER = re.compile(r"[0134578@$!]+(?=[^\W\d_])")
FULL_WIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}
FOREIGN = re.compile(f"[{''.join(map(chr, LOOKALIKES))}\uff01-\uff5e]")
PUNCTUATION = b"!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~$@"
BLANKED = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))

SHORTEST, LONGEST = 3, 7
LEAST_Z, LEAST_ODDS, LEAST_TEXTS = 4.0, 1.5, 3
FLUSH = 300_000


def fold(text: str) -> str:
    """The words of a text, folded, each with one space before it and one after the last."""
    text = text.lower()
    if not text.isascii() and FOREIGN.search(text):
        text = text.translate(FULL_WIDTH).lower().translate(LOOKALIKES)
    text = BEFORE_LETTER.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    words = text.encode("utf-8", "replace").translate(BLANKED).split()
    return " " + b" ".join(words).decode() + " "


@dataclass
class Lexicon:
    """Terms start with a space; those that end with one are whole words, the others beginnings."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    fitted: bool = False

    def automaton(self) -> ahocorasick.Automaton | None:
        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        if not len(machine):
            return None
        machine.make_automaton()
        return machine


def hits(machine: ahocorasick.Automaton | None, folded: str) -> dict[int, float]:
    """The greatest weight at each word start that no exception phrase covers."""
    found: dict[int, float] = {}
    if machine is None:
        return found
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in machine.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        elif weight > found.get(start, -math.inf):
            found[start] = weight
    for start, end in excused:
        for at in [p for p in found if start <= p < end]:
            del found[at]
    return found


def measures(machine: ahocorasick.Automaton | None, text: str | None) -> tuple[float, float]:
    """(log of the hit weight, log of the hit weight per hundred words)."""
    folded = fold(text or "")
    weight = sum(hits(machine, folded).values())
    words = max(1, folded.count(" ") - 1)
    return math.log1p(weight), math.log1p(100 * weight / words)


def _features(folded: str) -> set[str]:
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for n in range(SHORTEST, LONGEST + 1):
        found |= {" " + w[:n] for w in words if len(w) > n}
    return found


def _rows(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    terms = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()),
         pa.array([clean[t] for t in terms], pa.int64())],
        ["term", "toxic", "clean"],
    )


def _count(of_text):
    """Sum what of_text gives for each text, by label, in tables of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                (toxic if label else clean).update(of_text(fold(text or "")))
                if len(toxic) + len(clean) > FLUSH:
                    yield _rows(toxic, clean)
                    toxic.clear()
                    clean.clear()
        yield _rows(toxic, clean)

    return run


def _phrases(machine: ahocorasick.Automaton | None):
    def of_text(folded: str) -> set[str]:
        found = set()
        for at in hits(machine, folded):
            after = folded.find(" ", at + 1)
            if after + 1 < len(folded):
                found.add(folded[at : folded.find(" ", after + 1) + 1])
            if at:
                found.add(folded[folded.rfind(" ", 0, at) : after + 1])
        return found

    return of_text


def _measure(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            got = [measures(machine, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([g[0] for g in got], pa.float64()),
                 pa.array([g[1] for g in got], pa.float64())],
                ["toxic", "weight", "density"],
            )

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's steps for a lightly damped logistic curve, intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, damp = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (y - p) - damp @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _odds(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    return counts.withColumn("odds", odds).withColumn("z", odds / error)


def held_out(folds: int = 5) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = 40_000, most_terms: int = 20_000) -> Lexicon:
    """Learn lexicon, exceptions and curve from labelled rows that are not held out."""
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    sample = (
        usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    texts = stage_table(
        texts.withColumn("key", F.md5(F.coalesce("text", F.lit("")))).groupBy("key", "toxic").agg(
            F.min("doc_id").alias("doc_id"), F.first("text").alias("text")
        ),
        "labelled",
    )
    part = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    learn, tune = texts.where(~part), texts.where(part)
    of = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    toxic, clean = of.get(1, 0), of.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    schema = "term string, toxic long, clean long"
    total = lambda rows: rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    terms = (
        _odds(total(learn.select("text", "toxic").mapInArrow(_count(_features), schema)), toxic, clean)
        .where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS) & (F.col("toxic") >= LEAST_TEXTS))
        .orderBy(F.desc("z"), "term").limit(most_terms).select("term", "odds").collect()
    )
    lexicon = Lexicon({r["term"]: r["odds"] for r in terms})
    phrases = (
        _odds(total(learn.select("text", "toxic").mapInArrow(_count(_phrases(lexicon.automaton())), schema)), toxic, clean)
        .where((F.col("z") <= -2.0) & (F.col("clean") >= LEAST_TEXTS))
        .orderBy("z", "term").limit(most_terms).select("term").collect()
    )
    lexicon.exceptions = frozenset(r["term"] for r in phrases)
    rows = tune.select("text", "toxic").mapInArrow(_measure(lexicon), "toxic int, weight double, density double").toPandas()
    if rows["toxic"].nunique() == 2:
        lexicon.curve = tuple(_logistic(rows[["weight", "density"]].to_numpy(), rows["toxic"].to_numpy(float)))
        lexicon.fitted = True
    return lexicon


def _scores(machine: ahocorasick.Automaton | None, lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
    if not lexicon.fitted:
        return np.zeros(len(texts))
    x = np.array([measures(machine, t) for t in texts]).reshape(len(texts), 2)
    return 1 / (1 + np.exp(-np.clip(lexicon.curve[0] + x @ np.array(lexicon.curve[1:]), -35, 35)))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value.automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                got = _scores(machine, model.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(got, pa.float64())],
                    ["doc_id", "held_out", "score"],
                )

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs that score under 0.5, with all their columns; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value.automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                got = _scores(machine, model.value, part.column("text").to_pylist())
                yield part.filter(pa.array(got < 0.5))

    return docs.mapInArrow(run, docs.schema)
