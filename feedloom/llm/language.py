"""Language of texts, span by span: script ranges, per-word scores and a Viterbi path with a switching penalty."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import map_batches, once

#: First and last code point of scripts; letters elsewhere belong to one further script, "other".
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul_jamo", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPTS = ["none", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES), "other"]
GRAM_CELLS = 1 << 16  # hashed letter trigrams; bounds the model at 65,536 x languages
SAMPLE_PER_LANGUAGE = 4_000  # documents of each language that the scores are fitted on, about
SWITCH_PENALTY = 15.0  # nats: several words in a row must speak for another language
OUTSIDE = -30.0  # score of a word for a language that is not a candidate of its script
FAR_BELOW = 1.0  # nats per trigram under the labelled texts of a language, besides how these differ and chance
CHANCE = 4.0  # standard deviations that chance explains
CHARS_AT_ONCE = 400_000  # bounds a worker's arrays
UNKNOWN = "und"


@once
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Script of every code point (0: no letter) and its lower-case form."""
    size, last = 0x110000, 0x32400  # there are no letters beyond
    script, lower = np.zeros(size, np.uint8), np.arange(size, dtype=np.uint32)
    for code in range(last):
        char = chr(code)
        if unicodedata.category(char)[0] == "L":
            script[code] = len(SCRIPTS) - 1
            small = char.lower()
            if len(small) == 1:
                lower[code] = ord(small)
    for name, first, last in SCRIPT_RANGES:
        part = script[first:last + 1]
        part[part > 0] = SCRIPTS.index(name)
    return script, lower


@dataclass
class Words:
    """The words (runs of letters) of some texts: text number, first and last character, script, letter trigrams."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first_gram: np.ndarray
    grams: np.ndarray


def find_words(texts: list[str]) -> Words:
    scripts, lower = _tables()
    joined = "\n".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = scripts[codes]
    letter = script > 0
    before = np.concatenate([[False], letter[:-1]])
    after = np.concatenate([letter[1:], [False]])
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    small = np.where(letter, lower[codes], np.uint32(0))  # 0 marks both ends of a word
    at = np.flatnonzero(letter)
    x = np.where(at > 0, small[at - 1] * np.uint32(0x9E3779B1), np.uint32(0))
    x = (x ^ small[at]) * np.uint32(0x85EBCA6B)
    x = ((x ^ (x >> np.uint32(15))) ^ small[np.minimum(at + 1, len(small) - 1)]) * np.uint32(0xC2B2AE35)
    grams = ((x ^ (x >> np.uint32(16))) & np.uint32(GRAM_CELLS - 1)).astype(np.int32)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends_of_texts, start, "right")
    offset = np.concatenate([[0], ends_of_texts])[text]
    return Words(text, start - offset, end - offset, script[start], np.searchsorted(at, start), grams)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts, some millions of characters at a time; (number of the first, texts)."""
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (chars == 0 or chars + len(texts[end] or "") <= CHARS_AT_ONCE):
            chars += len(texts[end] or "") + 1
            end += 1
        yield start, [t or "" for t in texts[start:end]]
        start = end


@dataclass
class Model:
    """Languages, log-probabilities of trigrams (cells x languages), the languages each script may be in, and per
    language the variance of the score of a trigram, and mean and deviation of the mean scores of the labelled texts."""

    languages: list[str]
    scores: np.ndarray
    candidates: np.ndarray
    variance: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def supported(self, words: Words, scores: np.ndarray, paths: np.ndarray, n_grams: np.ndarray) -> tuple[np.ndarray, bool]:
        """Of the words of a text with their scores, labels and trigrams: which are in a script of their label, and
        whether these score about as the labelled texts of their languages do."""
        known = self.candidates[words.script, paths]
        n = np.where(known, n_grams, 0).astype(np.float64)
        excess = np.where(known, scores[np.arange(len(paths)), paths], 0).sum() - (n * self.mean[paths]).sum()
        chance = CHANCE * np.sqrt((n * self.variance[paths]).sum())
        return known, bool(excess >= -(n * (FAR_BELOW + 2 * self.deviation[paths])).sum() - chance)

    def word_scores(self, words: Words) -> np.ndarray:
        """One row per word, one column per language; a script that was never seen says nothing."""
        if not len(words.start):
            return np.zeros((0, len(self.languages)), np.float32)
        summed = np.add.reduceat(self.scores[words.grams], words.first_gram, axis=0)
        allowed = self.candidates[words.script]
        return np.where(allowed.any(axis=1)[:, None], np.where(allowed, summed, summed + np.float32(OUTSIDE)),
                        np.float32(0))


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, typical: bool = False) -> Model:
    """Fit on about `per_language` documents of each language, drawn by a hash of the text. Runs jobs.

    `labelled` holds text and lang; rows without either are left out. The languages are the distinct values of
    lang, taken to be a small closed set. Trigram counts are summed by Spark; cells x languages rows reach
    the driver at most. How the texts drawn score is measured only if `typical`; label() needs it for evidence.
    """
    labelled = labelled.select("text", "lang").dropna()
    found = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(found)
    if not languages:
        return Model([], np.zeros((GRAM_CELLS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool),
                     *[np.zeros(0)] * 3)
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, per_language / found[name]))])
    drawn = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 24)) < share[F.col("lang")] * (1 << 24))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(languages), GRAM_CELLS), np.int64)
        letters = np.zeros((len(languages), len(SCRIPTS)), np.int64)
        for batch in batches:
            numbers = np.array([languages.index(x) for x in batch.column(1).to_pylist()])
            for first, texts in _chunks(batch.column(0).to_pylist()):
                words = find_words(texts)
                of_word = numbers[first + words.text]
                of_gram = np.repeat(of_word, np.diff(np.append(words.first_gram, len(words.grams))))
                flat = of_gram * GRAM_CELLS + words.grams
                grams += np.bincount(flat, minlength=grams.size).reshape(grams.shape)
                flat = of_word * len(SCRIPTS) + words.script
                letters += np.bincount(flat, minlength=letters.size).reshape(letters.shape)
        for kind, table in enumerate((grams, letters)):
            number, cell = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cell), kind)), pa.array(number), pa.array(cell), pa.array(table[number, cell])],
                ["kind", "number", "cell", "n"])

    sums = (map_batches(drawn, count, "kind long, number long, cell long, n long").groupBy("kind", "number", "cell")
            .agg(F.sum("n").alias("n")).toArrow())
    kind, number, cell, n = (sums[c].to_numpy() for c in ("kind", "number", "cell", "n"))
    grams, letters = np.zeros((GRAM_CELLS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    grams[cell[kind == 0], number[kind == 0]] = n[kind == 0]
    letters[cell[kind == 1], number[kind == 1]] = n[kind == 1]
    scores = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * GRAM_CELLS)).astype(np.float32)
    candidates = letters > 0.01 * letters.sum(axis=0)  # a script counts for a language from 1 % of its words on
    shares = grams / np.maximum(1, grams.sum(axis=0))
    variance = (shares * (scores - (shares * scores).sum(axis=0)) ** 2).sum(axis=0)
    if not typical:
        return Model(languages, scores, candidates, variance, *[np.zeros(len(languages))] * 2)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(languages)))
        for batch in batches:
            numbers = np.array([languages.index(x) for x in batch.column(1).to_pylist()])
            for first, texts in _chunks(batch.column(0).to_pylist()):
                words = find_words(texts)
                if len(words.start):
                    n_grams = np.diff(np.append(words.first_gram, len(words.grams)))
                    own = np.add.reduceat(scores[words.grams, np.repeat(numbers[first + words.text], n_grams)],
                                          words.first_gram)
                    n = np.bincount(words.text, n_grams, len(texts))
                    mean = np.bincount(words.text, own, len(texts))[n > 0] / n[n > 0]
                    for k in range(3):
                        sums[k] += np.bincount(numbers[first:first + len(texts)][n > 0], mean ** k, len(languages))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages))), *map(pa.array, sums)],
                                         ["number", "n", "total", "squares"])

    rows = (map_batches(drawn, means, "number long, n double, total double, squares double").groupBy("number")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")).collect())
    mean, deviation = np.zeros(len(languages)), np.zeros(len(languages))
    for r in rows:
        if r["n"]:
            mean[r["number"]] = r["total"] / r["n"]
            deviation[r["number"]] = np.sqrt(max(0.0, r["squares"] / r["n"] - mean[r["number"]] ** 2))
    return Model(languages, scores, candidates, variance, mean, deviation)


def best_path(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The labels of the Viterbi path over the rows of `scores`, where each change of label costs `penalty`.

    If what every word gains by its best label over the best single one adds up to no more than the penalty, staying
    with that one is the best path. Nor can another path be better if no run of words gains more than half of the
    penalty by any other label: a path of k switches away from it has at most k + 1 runs of other labels. Then no table
    is filled.
    """
    n, labels = scores.shape
    single = int(scores.sum(axis=0).argmax())
    if n == 0 or labels == 1:
        return np.full(n, single)
    more = scores - scores[:, [single]]
    if more.max(axis=1).sum(dtype=np.float64) <= penalty:
        return np.full(n, single)
    gain = np.vstack([np.zeros((1, labels)), np.cumsum(more, axis=0, dtype=np.float64)])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(n, single)
    came = np.empty((n, labels), np.int16)
    stay = np.arange(labels)
    total = scores[0].astype(np.float64)
    for k in range(1, n):
        top = int(total.argmax())
        switch = total[top] - penalty > total
        came[k] = np.where(switch, top, stay)
        total = np.where(switch, total[top] - penalty, total) + scores[k]
    path = np.empty(n, np.int64)
    path[-1] = int(total.argmax())
    for k in range(n - 1, 0, -1):
        path[k - 1] = came[k, path[k]]
    return path


SCHEMA = "lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"


def label(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, evidence: str | None = None) -> DataFrame:
    """`docs` with lang_pred, score and spans, which replace columns of these names.

    Spans are runs of words of one language: lang, first character, end. lang_pred is the language that labels
    most letters (ties: the higher total score), score the share of letters it labels. A text that is null
    or has no letter is `und` with score 0 and no spans, as is every text if no language was learned.
    No other column than text is looked at.

    `evidence` names a further column: the share of letters that lang_pred labels in a script it is written in, and 0
    if the text scores far below the labelled texts of its languages.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    names = [*kept, "lang_pred", "score", "spans"]
    place = kept.index("text")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept], SCHEMA])
    if evidence is not None:
        names, schema = [*names, evidence], f"{schema}, `{evidence}` double"

    def one(words: Words, scores: np.ndarray, a: int, b: int) -> tuple[str, float, list[dict], float]:
        scores, start, end = scores[a:b], words.start[a:b], words.end[a:b]
        path = best_path(scores, penalty)
        letters = np.bincount(path, (end - start), len(model.languages))
        top = max(range(len(model.languages)), key=lambda k: (letters[k], float(scores[:, k].sum()), -k))
        cuts = np.flatnonzero(np.diff(path)) + 1
        spans = [{"lang": model.languages[path[a]], "start": int(start[a]), "end": int(end[b - 1])}
                 for a, b in zip([0, *cuts], [*cuts, len(path)])]
        support = 0.0
        if evidence is not None:
            firsts = words.first_gram[a:b + 1] if b < len(words.start) else np.append(words.first_gram[a:b], len(words.grams))
            mine = Words(words.text[a:b], start, end, words.script[a:b], firsts[:-1], words.grams)
            known, like = model.supported(mine, scores, path, np.diff(firsts))
            support = float((end - start)[known & (path == top)].sum() / letters.sum()) if like else 0.0
        return model.languages[top], float(letters[top] / letters.sum()), spans, support

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, shares, spans, supports = [], [], [], []
            for _, texts in _chunks(batch.column(place).to_pylist()):
                words = find_words(texts)
                scores = model.word_scores(words)
                cuts = np.searchsorted(words.text, np.arange(len(texts) + 1))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    found = one(words, scores, a, b) if b > a and model.languages else None
                    lang, share, runs, support = found or (UNKNOWN, 0.0, [], 0.0)
                    labels.append(lang)
                    shares.append(share)
                    spans.append(runs)
                    supports.append(support)
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, kind),
                 *([] if evidence is None else [pa.array(supports, pa.float64())])], names)

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in kept]), over, schema)


def accepted(docs: DataFrame, least_share: float = 0.3) -> DataFrame:
    """The rows of `docs` (columns text and lang at least) in which a learned language labels `least_share` of
    the letters, in a script it is written in: texts that mix a few languages stay. A text whose trigrams score far
    below those of the labelled texts of the languages it is taken for goes: none of them is its language.

    The languages are learned from the rows that name one; if none does, no row is rejected.
    """
    model = train(docs, typical=True)
    if not model.languages:
        return docs
    columns = docs.columns
    found = label(docs, model, evidence="__evidence")
    return found.filter(f"lang_pred <> '{UNKNOWN}' and __evidence >= {least_share}").select(*columns)
