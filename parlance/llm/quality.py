"""Quality rules by distribution divergence (DataFrame functions only).

Each document has two histograms: characters by class and words by common
word.  Language references are the pooled histograms of the documents of each
language over the whole corpus.  A document is compared with every reference
by Jensen-Shannon distance (base 2, so between 0 and 1); its divergence is the
distance to the nearest reference.  A document whose character or word
histogram is further than the threshold from every language is rejected.
Histograms of short texts are noise, so a text below the length guard of a
histogram is not judged by it.

Cases: a null text counts as empty; an empty text fails the base rule (fewer
than 50 words) and has null distances.  Without any reference (no document of
the listed languages passes the guards) only the base rule decides.  Repeated
rows are judged alike, each on its own; other columns pass through, but for
names that the operator adds, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import quoted, words

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": ("the", "of", "and", "a", "to", "in", "is", "that", "it", "for", "was", "with"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "nicht", "ein"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "por", "un", "para"),
}

# Character classes, in the order in which they are taken out of the text.
CLASSES = (
    ("small", "[a-z]+"),
    ("blank", r"[\x20\x09-\x0D]+"),
    ("capital", r"\p{Lu}+"),
    ("letter", r"[\p{L}\p{M}]+"),
    ("stop", r"[.,;:!?'\"()\-]+"),
    ("digit", r"\p{N}+"),
)


@dataclass(frozen=True)
class QualityRules:
    """Parameters.  Distances are on [0, 1]; guards are in characters and words."""

    languages: tuple[str, ...] = ("en", "de", "fr", "es")
    max_class_distance: float = 0.28
    max_word_distance: float = 0.30
    min_chars: int = 200
    min_words: int = 100
    common: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(COMMON_WORDS))

    @property
    def bins(self) -> list[str]:
        return sorted({w for ws in self.common.values() for w in ws})


def _size(s: Column) -> Column:
    return F.length(s).cast("long")


def histograms(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """Adds class_counts (array, CLASSES then the rest), word_counts (bins, then the rest), n_words, text_chars, word_chars,
    n_symbols."""
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_words", words(F.col("_text")))
    rest = F.col("_text")
    steps = []
    for i, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"_rest{i}", F.regexp_replace(rest, pattern, ""))
        steps.append(_size(rest) - _size(F.col(f"_rest{i}")))
        rest = F.col(f"_rest{i}")
    df = df.withColumn("class_counts", F.array(*steps, _size(rest)))
    forms = sorted({f for b in rules.bins for f in (b, b.capitalize(), b.upper())})
    common = F.filter("_words", lambda w: w.isin(forms))
    df = df.withColumn("_common", common)
    # each as |word|, so that taking a word out of the joined text shows its count
    df = df.withColumn("_joined", F.lower(F.concat(F.lit("|"), F.array_join("_common", "||"), F.lit("|"))))
    n_common = F.size("_common").cast("long")
    counts = [((F.octet_length("_joined") - F.octet_length(F.replace(F.col("_joined"), F.lit(f"|{b}|"), F.lit(""))))
               / (len(b.encode()) + 2)).cast("long") for b in rules.bins]
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_counts", F.array(*counts, F.col("n_words") - n_common))
    # the last rest holds every character that no class took, so all symbols
    df = df.withColumn("n_symbols", F.regexp_count(rest, F.lit(r"[#*$%&|<>]")).cast("long"))
    blank = [name for name, _ in CLASSES].index("blank")
    df = df.withColumn("text_chars", _size(F.col("_text")))
    df = df.withColumn("word_chars", F.col("text_chars") - F.col("class_counts")[blank])
    return df.drop("_text", "_common", "_joined", *(f"_rest{i}" for i in range(len(CLASSES))))


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_dup_lines and n_repeat_words; needs the word array ``_words``.

    Repeated windows are found by sorting the 64-bit hashes of the 3-word
    windows with their positions, so the cost is n log n in the row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n3 = F.greatest(F.size("_words") - 2, F.lit(0))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    pair = F.zip_with(F.slice("_hashes", 1, n3), F.slice("_hashes", 2, n3), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_windows", F.zip_with(pair, F.slice("_hashes", 3, n3), lambda h, w: F.xxhash64(h, w)))
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_by_hash", F.col("_sorted.h"))
    df = df.withColumn("_same", F.zip_with(
        "_by_hash", F.slice("_by_hash", 2, F.greatest(F.size("_by_hash"), F.lit(1)) - 1),
        lambda a, b: F.coalesce(a == b, F.lit(False))))
    twin = F.filter("_sorted.i", lambda _, k: F.col("_same")[k] | ((k > 0) & F.col("_same")[F.greatest(k - 1, F.lit(0))]))
    df = df.withColumn("_at", F.sort_array(twin))
    gaps = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))),
                      lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    return (
        df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(
            F.aggregate(gaps, F.lit(0), lambda s, g: s + g), F.lit(0)).cast("long"))
        .drop("_hashes", "_windows", "_sorted", "_by_hash", "_same", "_at", "_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def language_references(hists: DataFrame, rules: QualityRules = QualityRules(), lang: str = "lang") -> list:
    """Pooled shares per language: one row for each of ``rules.languages`` at most.

    One aggregation of fixed-width sums; what reaches the driver is bounded by
    the parameter, not by the data.
    """
    n_class, n_bin = len(CLASSES) + 1, len(rules.bins) + 1
    long_enough = F.col("n_words") >= rules.min_words
    sums = [F.sum(F.col("class_counts")[i]).alias(f"c{i}") for i in range(n_class)]
    sums += [F.sum(F.col("word_counts")[i]).alias(f"w{i}") for i in range(n_bin)]
    rows = (hists.where(F.col(lang).isin(list(rules.languages)) & long_enough)
            .groupBy(F.col(lang).alias("_lang")).agg(*sums).orderBy("_lang").collect())
    out = []
    for r in rows:
        c, w = [r[f"c{i}"] for i in range(n_class)], [r[f"w{i}"] for i in range(n_bin)]
        out.append((r["_lang"], [x / sum(c) for x in c], [x / sum(w) for x in w]))
    return out


def js_distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a count array to fixed shares; null if the total is zero."""
    shares = F.transform(counts, lambda x: x / total)

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        left = F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
        right = F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))
        return (left + right) / 2

    parts = F.zip_with(shares, F.array(*[F.lit(float(x)) for x in reference]), term)
    divergence = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judge(counted: DataFrame, references: list, rules: QualityRules = QualityRules()) -> DataFrame:
    """Adds class_distance, word_distance, base_failed, kept and reason."""
    def nearest(col: str, total: str, at: int) -> Column:
        each = [js_distance(F.col(col), F.col(total), r[at]) for r in references]
        return F.least(*each) if len(each) > 1 else each[0] if each else F.lit(None).cast("double")

    df = (counted.withColumn("class_distance", nearest("class_counts", "text_chars", 1))
          .withColumn("word_distance", nearest("word_counts", "n_words", 2))
          .withColumn("base_failed", base_failed()))
    bad_class = (F.col("text_chars") >= rules.min_chars) & (F.col("class_distance") > rules.max_class_distance)
    bad_word = (F.col("n_words") >= rules.min_words) & (F.col("word_distance") > rules.max_word_distance)
    reason = (F.when(F.col("base_failed"), "base").when(bad_class, "characters").when(bad_word, "words"))
    return df.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
          "class_distance", "word_distance", "reason")


def kept_documents(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns.

    Two scans: one for the references, one that judges and filters, so texts
    are neither stored nor joined.
    """
    references = language_references(histograms(docs, rules), rules)
    mark = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_doc")
    rows = docs.select(mark, F.col("text"), F.col("lang"))
    judged = judge(base_counts(histograms(rows, rules)), references, rules)
    # the row number keeps the optimizer from copying the whole chain of expressions into the filter
    judged = judged.select("_doc", "kept", F.monotonically_increasing_id().alias("_row"))
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select("_doc.*")
