"""Quality rules by distribution divergence, in DataFrame functions only.

A text's histograms of character classes and of common words are compared by Jensen-Shannon
distance to references of each language, which are means over the whole corpus. Short texts
have noisy histograms, so the limits widen with 1 / sqrt(length), and a histogram of less than a
least length isn't compared at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import SPACES, let, staged, word_count

COMMON = {
    "en": "the of and to a in is that it for was on with as by be this are at from",
    "fr": "de la le et les des en un du une que pour est dans qui par sur pas au avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y los se las del un por con no una su para al es lo",
}
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
#: Classes of characters by what is removed in turn; the rest is the last class.
CLASSES = (("lower", "[a-z]+"), ("blank", r"[\x20\x09-\x0D]+"), ("letter", r"[^\P{L}A-Z]+"), ("upper", "[A-Z]+"), ("stop", r"[.,;:!?'\"()\-]+"), ("digit", "[0-9]+"))
#: Least words for the base rules; least code points and words for histograms to be compared; the
#: largest distances of long texts and what short ones may have more, over the square root of
#: the number of words.
BASE_WORDS = 50
LEAST_CHARS, LEAST_WORDS = 300, 80
MOST_CHARS, MOST_WORDS, SLACK_CHARS, SLACK_WORDS = 0.12, 0.06, 1.3, 2.6


def _trie(words: list[str]) -> str:
    """A regular expression of the words that shares their beginnings."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], []).append(w[1:])
    end = by_first.pop("", None) is not None
    parts = [c + _trie(rest) for c, rest in sorted(by_first.items())]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)}){'?' if end else ''}"


#: A word that is none of WORDS, and each place where three words follow.
OTHER_WORD = rf"(?<!\S)(?!{_trie(WORDS)}(?!\S))\S+"
WINDOW = r"(?<!\S)(?=(\S+ \S+ \S+))"


def repeated_words(spaced: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, first ones included.

    ``spaced`` has one space between words. If some window isn't distinct, windows are sorted
    with their places; equal neighbours are repeats. No text leaves its row.
    """

    def places(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))

        return F.transform(F.filter(s, twin), lambda x: x["i"])

    def union(p: Column) -> Column:
        return F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))

    def covered(windows: Column) -> Column:
        numbered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        repeats = let(let(numbered, places), union)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(repeats)

    return let(F.regexp_extract_all(spaced, F.lit(WINDOW), F.lit(1)), covered).cast("long")


def counts(documents: DataFrame) -> DataFrame:
    """The base numbers and histograms of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", "lang", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = F.regexp_replace(F.regexp_replace(F.lower("text"), OTHER_WORD, ""), SPACES + "+", "  ")
    rows = rows.select(
        "doc_id",
        "lang",
        "text",
        word_count(F.col("text")).alias("n_words"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.regexp_replace("text", SPACES + "+", " ")).alias("n_repeat_words"),
        F.concat(F.lit(" "), common, F.lit(" ")).alias("common"),
    )
    rest, sizes = F.col("text"), []
    for name, pattern in CLASSES:
        rows = rows.withColumn(f"left_{name}", F.regexp_replace(rest, pattern, ""))
        rest, sizes = F.col(f"left_{name}"), [*sizes, F.length(rest) - F.length(f"left_{name}")]
    sizes.append(F.length(rest))
    hits = [(F.length("common") - F.length(F.replace(F.col("common"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2) for w in WORDS]
    return rows.select(
        "doc_id",
        "lang",
        "n_words",
        (F.length("text") - sizes[1]).cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.array(*sizes).alias("chars"),
        F.array(*(h.cast("int") for h in hits)).alias("hits"),
    )


def shares(language: str) -> list[Column]:
    """Shares of a language's common words, and of all other words."""
    own = [F.col("hits")[WORDS.index(w)] / F.greatest("n_words", F.lit(1)) for w in COMMON[language].split()]
    return [*own, F.greatest(F.lit(0.0), 1 - reduce(lambda a, b: a + b, own))]


def char_shares() -> list[Column]:
    total = F.greatest(F.lit(1), F.aggregate("chars", F.lit(0), lambda a, x: a + x))
    return [F.col("chars")[i] / total for i in range(len(CLASSES) + 1)]


def references(counted: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of each language over all its texts of LEAST_WORDS words or more.

    Every text weighs the same, however long. A row for each language reaches the driver.
    """
    found = {}
    chars = char_shares()
    own = {k: shares(k) for k in COMMON}
    rows = counted.where((F.col("n_words") >= LEAST_WORDS) & F.col("lang").isin(list(COMMON)))
    every = [F.avg(c).alias(f"c{i}") for i, c in enumerate(chars)]
    every += [F.avg(F.when(F.col("lang") == k, c)).alias(f"{k}{i}") for k in COMMON for i, c in enumerate(own[k])]
    for r in rows.groupBy("lang").agg(*every).collect():
        k = r["lang"]
        found[k] = ([r[f"c{i}"] for i in range(len(chars))], [r[f"{k}{i}"] for i in range(len(own[k]))])
    return found


def distance(shares: list[Column], reference: list[float]) -> Column:
    """Jensen-Shannon distance, 0 to 1: the root of the divergence in bits."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = [half(p, F.lit(float(q))) + half(F.lit(float(q)), p) for p, q in zip(shares, reference, strict=True)]
    return F.sqrt(F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, terms) / 2))


def judge(documents: DataFrame) -> DataFrame:
    """Base numbers, distances to the nearest reference and the verdict of each document.

    A document is kept if it passes the base rules and, for some language, both distances are
    within their limits. Character classes of texts of under LEAST_CHARS code points and common
    words of texts of under LEAST_WORDS words are too few to tell and exceed nothing. Null and empty texts have no words and fail the base rules; a null or
    unknown lang only means that the row adds to no reference. Repeated rows are judged alike,
    other columns are ignored, and an empty table gives no rows. Without any reference the base
    rules decide. Texts are read once, nothing but counts leaves their row.
    """
    counted = staged(counts(documents), "quality-counts")
    known = references(counted)
    chars = char_shares()
    slack = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    long_chars = F.aggregate("chars", F.lit(0), lambda a, x: a + x) >= LEAST_CHARS
    long_words = F.col("n_words") >= LEAST_WORDS
    near = F.array(
        *(
            F.struct(
                F.greatest(F.lit(0.0), F.when(long_chars, dc / (MOST_CHARS + SLACK_CHARS / slack)), F.when(long_words, dw / (MOST_WORDS + SLACK_WORDS / slack))).alias("excess"),
                F.lit(k).alias("language"),
                dc.alias("js_chars"),
                dw.alias("js_words"),
            )
            for k, (c, w) in sorted(known.items())
            for dc, dw in [(distance(chars, c), distance(shares(k), w))]
        )
    )
    rows = counted.withColumn("base_failed", (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    if not known:
        near = F.array(F.struct(F.lit(0.0).alias("excess"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("js_chars"), F.lit(None).cast("double").alias("js_words")))
    rows = rows.withColumn("near", F.array_min(near))
    kept = ~F.col("base_failed") & (F.col("near.excess") <= 1)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "near.language", "near.js_chars", "near.js_words")
