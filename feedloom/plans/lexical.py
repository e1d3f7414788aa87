"""A small scorer that reads the sentence: it counts cue words per label. As columns, as SQL, and as a plain call.

The registered queries need answers, and the given tables hold none; this gives every sentence answers that follow
from its words, the same in all three forms. Two scorers are compared: "b" knows one cue less per list.
"""

from __future__ import annotations

import json
import string
from collections.abc import Sequence
from functools import reduce

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}+"
SHARPNESS = {"a": 4.0, "b": 3.0}  # how much of a sentence must be cues for a full score: one word in so many

LANGUAGE_CUES = {
    "english": ["the", "of", "and", "to", "is", "that", "it", "for", "with", "by", "this", "are"],
    "french": ["le", "les", "des", "et", "une", "qui", "pour", "dans", "pas", "sur", "du", "au"],
    "german": ["der", "die", "das", "und", "nicht", "ist", "mit", "ein", "sich", "zu", "von", "den"],
    "spanish": ["el", "los", "las", "y", "una", "por", "con", "para", "como", "se", "del", "al"],
}
PROBLEM_CUES = {
    "build_quality": ["broke", "broken", "rust", "flimsy", "cheap", "was", "étaient", "las"],
    "performance": ["heat", "slow", "uneven", "burnt", "weak", "not", "über", "mais"],
    "ease_of_use": ["awkward", "confusing", "fiddly", "hard", "on", "auf", "dans"],
    "assembly": ["assemble", "instructions", "missing", "screws", "as", "aus"],
    "cleaning_maintenance": ["clean", "grease", "ash", "stain", "be", "bei"],
    "size_capacity": ["small", "big", "short", "fit", "by", "une", "una"],
    "safety": ["fire", "gas", "leak", "burn", "unsafe", "are", "sind"],
    "shipping_delivery": ["late", "lost", "box", "delivery", "from", "von"],
    "customer_service": ["support", "refund", "warranty", "return", "this", "sich"],
    "price_value": ["price", "expensive", "money", "overpriced", "or", "du"],
    "general_dissatisfaction": ["worst", "disaster", "disappointed", "worthless", "have", "se"],
    "other": ["strange", "odd", "weird", "from", "au"],
}
SENTIMENT_CUES = {
    "positive": ["good", "great", "love", "happy", "perfect", "with", "avec", "mit", "con", "is"],
    "negative": ["bad", "poor", "hate", "broke", "never", "was", "not", "pas", "nicht", "no"],
    "mixed": ["but", "although", "however", "aber", "mais", "pero", "that", "que"],
}
RECOMMENDATION_CUES = {
    "recommends": ["recommend", "buy", "worth", "must", "for", "pour", "zu", "para"],
    "warns_against": ["avoid", "elsewhere", "stay", "never", "it", "ne", "den", "del"],
}
CHOICE_CUES = {"problem_category": (PROBLEM_CUES, "none"), "language": (LANGUAGE_CUES, "other"),
               "sentiment": (SENTIMENT_CUES, "neutral"), "recommendation": (RECOMMENDATION_CUES, "none")}
DENSITY_CUES = {
    "frustration": ["worst", "useless", "angry", "never", "worthless", "was", "of", "les", "und", "que"],
    "churn_risk": ["leaving", "switch", "again", "last", "on", "to", "de", "die", "el"],
    "safety_concern": ["fire", "burn", "gas", "dangerous", "it", "in", "la", "das", "los"],
    "suggestion": ["should", "could", "wish", "please", "be", "and", "et", "ein", "por"],
    "competitor_mention": ["brand", "instead", "than", "other", "as", "the", "des", "der", "las"],
    "own_mention": ["it", "this", "product", "is", "le", "der", "en"],
    "other_mention": ["that", "another", "those", "the", "un", "den", "de"],
}


def cues(words: list[str], salt: str) -> list[str]:
    return words if salt == "a" else words[:-1]


# --- as columns --------------------------------------------------------------------------------

def words_of(sentence: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(sentence)), F.lit(f"({WORD})"), F.lit(1))


def lists_of(salt: str) -> dict[str, list[str]]:
    """Every cue list by its mark, one letter: the labels of the choices in their order, then the densities."""
    lists = [cues(words, salt) for labels, _ in CHOICE_CUES.values() for words in labels.values()]
    lists += [cues(words, salt) for words in DENSITY_CUES.values()]
    return dict(zip(string.ascii_letters, lists, strict=False))


# the last cue of a list, which only "a" knows, has a mark of its own: so one walk over the words serves both scorers
LAST = dict(zip(string.ascii_letters, (chr(0x100 + k) for k in range(len(string.ascii_letters))), strict=True))

NAMES = [(name, label) for name, (labels, _) in CHOICE_CUES.items() for label in labels] \
    + [(name, "") for name in DENSITY_CUES]
MARKS = dict(zip(NAMES, string.ascii_letters, strict=False))
Names = Sequence[tuple[str, str]]


def marks(words: str) -> Column:
    """The marks of the lists each word is on, as one string: a single walk over the words, whatever the lists and for
    either scorer."""
    found: dict[str, str] = {}
    for mark, listed in lists_of("a").items():
        for k, word in enumerate(listed, 1):
            found[word] = found.get(word, "") + (LAST[mark] if k == len(listed) else mark)
    # a map is searched entry by entry: one per length of word keeps that short
    books = {n: {w: m for w, m in sorted(found.items()) if len(w) == n} for n in sorted({*map(len, found)})}
    of_length = F.create_map(*[x for n, book in books.items() for x in (
        F.lit(n), F.create_map(*[F.lit(x) for pair in book.items() for x in pair]))])
    return F.array_join(F.transform(F.filter(words, lambda w: w.isin(sorted(found))), lambda w: of_length[F.length(w)][w]), "")


def known(salt: str) -> Column:
    """The column `marks` as a scorer sees it: "a" makes no difference between a list's cues, "b" leaves out the last."""
    return F.translate("marks", "".join(LAST.values()), "".join(LAST) if salt == "a" else "")


def found(names: Names = NAMES) -> Column:
    """How many words are on each list of `names`, from the column `known`: one short loop instead of wide generated code,
    which the JVM would leave uncompiled."""
    every = F.array(*[F.lit(MARKS[n]) for n in names]).cast("array<string>")
    return F.transform(every, lambda m: F.length("known") - F.length(F.replace(F.col("known"), m, F.lit(""))))


def hits(name: str, names: Names = NAMES) -> Column:
    """How many words of the sentence are cues of a density, from its column `found` of the same `names`."""
    return F.col("found")[names.index((name, ""))]


def density(name: str, salt: str, names: Names = NAMES) -> Column:
    """0 to 1, from the share of cues among the words (`n`, at least 1)."""
    return F.least(F.lit(1.0), F.lit(SHARPNESS[salt]) * hits(name, names) / F.col("n"))


def counts(name: str, names: Names = NAMES) -> Column:
    """The cues found per label of a choice, in the order of the labels."""
    lists, _ = CHOICE_CUES[name]
    return F.slice("found", names.index((name, next(iter(lists)))) + 1, len(lists))


def choice(name: str, per_label: Column) -> tuple[Column, Column]:
    """The label of most cues, the first of several, and how far it leads; `per_label` is a column of `counts`."""
    lists, otherwise = CHOICE_CUES[name]
    best = F.array_max(per_label)
    label = F.when(best == 0, otherwise).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in lists]), F.array_position(per_label, best).cast("int")))
    return label, (best + 1.0) / (reduce(Column.__add__, [per_label[k] for k in range(len(lists))]) + 1.0)


# --- as SQL over the columns words and n ---------------------------------------------------------

def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_words(sentence: str) -> str:
    return f"regexp_extract_all(lower({sentence}), '{WORD}')"


def sql_hits(words: list[str]) -> str:
    return f"len(list_filter(words, lambda w: list_contains({_list(words)}, w)))"


def sql_density(name: str, salt: str) -> str:
    return f"least(1::DOUBLE, {SHARPNESS[salt]}::DOUBLE * {sql_hits(cues(DENSITY_CUES[name], salt))} / n)"


def sql_choice(name: str, salt: str) -> tuple[str, str]:
    lists, otherwise = CHOICE_CUES[name]
    found = "[" + ", ".join(sql_hits(cues(words, salt)) for words in lists.values()) + "]"
    best = f"list_max({found})"
    label = (f"CASE WHEN {best} = 0 THEN '{otherwise}' ELSE ({_list(list(lists))})[list_position({found}, {best})] END")
    return label, f"({best} + 1)::DOUBLE / (list_sum({found}) + 1)::DOUBLE"


# --- as a call -----------------------------------------------------------------------------------

WORDS = regex.compile(WORD)
FRUSTRATED = frozenset(DENSITY_CUES["frustration"])


def ask(row: dict) -> dict:
    """Score one sentence, from its state if there is one. A sentence of fewer than two words is refused."""
    sentence = json.loads(row["state"])["sentence"] if row.get("state") else row["sentence"]
    words = WORDS.findall(sentence.lower(), concurrent=False)  # too short to let other threads run meanwhile
    if len(words) < 2:
        raise TimeoutError("busy")
    found = sum(w in FRUSTRATED for w in words)
    return {"answers": {"frustration": {"score": min(1.0, SHARPNESS["a"] * found / len(words)) * 4.4 - 0.2,
                                        "confidence": (found + 1.0) / (len(words) + 1.0) * 1.1 - 0.05}},
            "input_tokens": 2600 + len(sentence), "output_tokens": 3 * len(words)}
