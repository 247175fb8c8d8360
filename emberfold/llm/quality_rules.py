"""Quality rules: base counts and a Jensen-Shannon test against language references.

Native: DataFrame functions only, one pass for the features and one over the slim features for the verdict.

Each document gives two histograms: code points by character class, and words by each language's list of very common
words (anything else is one more bin). A word counts as common when it stands by itself, in lower case or capitalised,
so that decorated or shouted words move a histogram as well. The mean histogram of each language over *all* its
documents is that language's reference, so a long document counts no more than a short one. From the base-2 Jensen-Shannon divergence (the square of the distance)
of the words goes what a sample of the document's length shows by chance. A document is kept if for some language the
two divergences, each divided by its limit, add up to one at most. A document under the minimum lengths is not judged
by divergence, as its histograms are noise; the base rule alone decides there.

Defined results: a null text counts as ''; '' has no words and fails the base rule. Repeated rows and ties are judged
alike. Rows with a null or unlisted language are judged but make no reference. An empty table gives no rows; where no
language has a reference, the base rule alone decides. Extra columns pass through untouched: everything added is in the
two struct columns BASE and MEASURE.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, whole_text

BASE, MEASURE = "__ef_base", "__ef_measure"

# Very common words of four languages.
COMMON_WORDS = {
    "en": "the of and to in is that for was with on be".split(),
    "de": "der die und in den von zu das mit sich des auf".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y los del se las por un".split(),
}
# White space of the word rule, what a symbol is, and the further classes; the rest is lower case or "other".
BLANKS = " \t\n\x0b\x0c\r"
RARE_CLASSES = {"symbol": r"#*$%&|<>", "upper": "A-Z", "digit": "0-9", "stop": r".,;:?'\"()\-", "shout": "!"}
CLASSES = ("lower", *RARE_CLASSES, "other")
#: Places of windows are packed in so many bits beside the hash.
PLACE_BITS = 31


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: No verdict by distance under these lengths.
    judged_words: int = 50
    judged_chars: int = 200
    #: A document goes when its divergences, each as a part of its limit, add up to more than one.
    class_limit: float = 0.10
    word_limit: float = 0.05
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for words in self.common_words.values() for w in words})


def _repeats(docs: DataFrame, words: str) -> tuple[DataFrame, Column]:
    """Words inside three-word windows that occur twice or more, with the columns that this needs.

    Windows are sorted as (hash bits, place) packed in a long; those with equal neighbours are sorted once more by their
    words, so the count is exact. All in O(n log n) for a text of n words.
    """
    w, packed, spelled, places = F.col(words), F.col("__ef_packed"), F.col("__ef_spelled"), F.col("__ef_places")
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    pack = lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS).bitwiseOR(i)
    bits = lambda x: F.shiftright(x, PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    # A neighbour outside the array is null, and so is no match.
    twins = F.filter(packed, lambda x, k: (bits(x) == bits(F.get(packed, k + 1))) | (bits(x) == bits(F.get(packed, k - 1))))
    spell = F.transform(twins, lambda x: F.struct(*(F.get(w, place(x) + j).alias(f"w{j}") for j in range(3)), place(x).alias("at")))
    same = lambda x, y: (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])
    found = F.filter(spelled, lambda x, k: same(x, F.get(spelled, k + 1)) | same(x, F.get(spelled, k - 1)))
    out = (
        docs.withColumn("__ef_packed", F.sort_array(F.transform(starts, pack)))
        .withColumn("__ef_spelled", F.array_sort(spell))
        .withColumn("__ef_places", F.sort_array(F.transform(found, lambda x: x["at"])))
    )
    covered = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    return out, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)


def features(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """Add BASE (the counts of the base rule) and MEASURE (both histograms, as counts)."""
    whole, w, hits, rare = whole_text(text), F.col("__ef_words"), F.col("__ef_hits"), F.col("__ef_rare")
    vocabulary = rules.vocabulary
    spellings = sorted({*vocabulary, *(v.capitalize() for v in vocabulary)})
    trimmed = F.trim(whole, F.lit(BLANKS))
    out = docs.withColumn("__ef_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    out, repeats = _repeats(out, "__ef_words")
    out = (
        out.withColumn("__ef_lines", F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != ""))
        .withColumn("__ef_hits", F.transform(F.filter(w, lambda x: x.isin(spellings)), F.lower))
        .withColumn("__ef_rare", F.regexp_replace(whole, r"[a-z\x20\x09-\x0D]+", ""))
        .withColumn("__ef_chars", F.length(whole).cast("long"))
        .withColumn("__ef_word_chars", F.length(F.array_join(w, "")).cast("long"))
    )
    lines, chars, word_chars = F.col("__ef_lines"), F.col("__ef_chars"), F.col("__ef_word_chars")
    out = out.withColumn("__ef_classes", F.struct(F.length(rare).cast("long").alias("rare"), *(F.length(F.regexp_replace(rare, f"[^{members}]+", "")).cast("long").alias(c) for c, members in RARE_CLASSES.items())))
    classes = F.col("__ef_classes")
    other = classes["rare"] - sum((classes[c] for c in RARE_CLASSES), F.lit(0))
    base = F.struct(
        F.size(w).cast("long").alias("n_words"),
        word_chars.alias("word_chars"),
        classes["symbol"].alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    )
    measure = F.struct(
        chars.alias("n_chars"),
        F.array(word_chars - classes["rare"], *(classes[c] for c in RARE_CLASSES), other).alias("classes"),
        F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.size(F.filter(hits, lambda x: x == v)).cast("long")).alias("words"),
    )
    added = [c for c in out.columns if c.startswith("__ef_") and c not in docs.columns]
    return out.withColumn(BASE, base).withColumn(MEASURE, measure).drop(*added)


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.when(total > 0, c / total).otherwise(F.lit(0.0)))


def _histograms(rules: Rules) -> dict[str, dict[str, Column]]:
    """For each listed language, the shares by kind: classes of word characters; its own common words and the rest."""
    base, m, vocabulary = F.col(BASE), F.col(MEASURE), rules.vocabulary
    classes, out = _shares(m["classes"], base["word_chars"]), {}
    for lang, words in rules.common_words.items():
        own = F.array(*(F.get(m["words"], F.lit(vocabulary.index(w))) for w in words))
        rest = base["n_words"] - F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
        out[lang] = {"classes": classes, "words": _shares(F.concat(own, F.array(rest)), base["n_words"])}
    return out


def _judged(rules: Rules) -> Column:
    return (F.col(BASE)["n_words"] >= rules.judged_words) & (F.col(MEASURE)["n_chars"] >= rules.judged_chars)


def references(measured: DataFrame, rules: Rules = Rules(), lang: str = "lang") -> dict[str, dict[str, list[float]]]:
    """Each listed language's mean histograms, over all of its documents that are long enough to judge.

    The result has a row for each listed language at most, so it is brought to the driver.
    """
    shares, own, known = _histograms(rules), None, {}
    for name, kinds in shares.items():
        both = F.concat(kinds["classes"], kinds["words"])
        own = F.when(F.col(lang) == name, both) if own is None else own.when(F.col(lang) == name, both)
    rows = measured.where(F.col(lang).isin(list(shares)) & _judged(rules)).select(F.col(lang).alias("name"), own.alias("own"))
    most = len(CLASSES) + max(map(len, rules.common_words.values())) + 1
    for r in rows.groupBy("name").agg(*(F.avg(F.get("own", F.lit(i))).alias(f"s{i}") for i in range(most))).collect():
        means = [r[f"s{i}"] for i in range(len(CLASSES) + len(rules.common_words[r["name"]]) + 1)]
        known[r["name"]] = {"classes": means[: len(CLASSES)], "words": means[len(CLASSES) :]}
    return known


def divergence(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon divergence, base 2, from 0 to 1."""

    def part(p: Column, q: Column) -> Column:
        one = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
        return (one(p) + one(q)) / 2

    parts = F.zip_with(shares, F.array(*(F.lit(float(q)) for q in reference)), part)
    return F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def judge(measured: DataFrame, known: dict[str, dict[str, list[float]]], rules: Rules = Rules()) -> DataFrame:
    """Replace MEASURE by the divergences from the nearest language, and add base_failed and kept to BASE."""
    base, shares = F.col(BASE), _histograms(rules)
    failed = (base["n_words"] < rules.min_words) | (100 * base["n_repeat_words"] > rules.max_repeat_percent * base["n_words"])
    nearest = []
    for lang, r in sorted(known.items()):
        by_class, by_word = divergence(shares[lang]["classes"], r["classes"]), divergence(shares[lang]["words"], r["words"])
        chance = (len(r["words"]) - 1) / (8 * math.log(2)) / F.greatest(base["n_words"], F.lit(1))
        excess = by_class / rules.class_limit + F.greatest(F.lit(0.0), by_word - chance) / rules.word_limit
        nearest.append(F.struct(excess.alias("excess"), F.lit(lang).alias("lang"), by_class.alias("by_class"), by_word.alias("by_word")))
    none = F.struct(F.lit(0.0).alias("excess"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("by_class"), F.lit(0.0).alias("by_word"))
    best = F.array_min(F.array(*nearest)) if nearest else none
    out = measured.withColumn("__ef_judged", _judged(rules)).withColumn(MEASURE, best)
    kept = ~failed & (~F.col("__ef_judged") | (F.col(MEASURE)["excess"] <= 1.0))
    return out.withColumn(BASE, base.withField("base_failed", failed).withField("kept", kept)).drop("__ef_judged")
