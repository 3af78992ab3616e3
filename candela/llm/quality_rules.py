"""Quality rules, in DataFrame functions only: counts over words and lines, and the divergence of a document's character
classes and common words from its language's reference, by Jensen-Shannon distance.

The references are the summed histograms of all documents of a language that pass the base rules, so they follow the
corpus. Short documents are guarded: the word histogram is compared only where there are enough words, the character
histogram only where there are enough characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import stored

#: Frequent function words of English, French, German and Spanish.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be by this",
    "fr": "de la le et les des un une en du que est pour dans qui sur",
    "de": "der die und das ein eine den von zu mit sich auf für ist nicht",
    "es": "de la que el en y a los se del las un por con no una",
}
WORDS = sorted({w for ws in COMMON.values() for w in ws.split()})
#: Character classes, taken out of the text one after the other; what is left is the last class.
CLASSES = (("lower", r"\p{Ll}+"), ("space", r"\s+"), ("upper", r"\p{Lu}+"), ("punctuation", r"[.,;:'\"!?()-]+"), ("digit", r"\p{N}+"))

MIN_WORDS, MIN_CHARS, MIN_COMPARED = 50, 400, 80
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.36
_WS = r"[\x20\x09-\x0D]+"


#: Reference rows of about 1 KB each that are broadcast; with more languages than this they are joined by a shuffle.
MAX_BROADCAST = 10_000


def features(docs: DataFrame, keep: list[str], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``keep`` as k0, k1, ..., lang, the base counts and the two histograms of each document with their totals."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [f"k{i}" for i in range(len(keep))]
    d = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text.alias("text"), F.array_remove(F.split(text, _WS), "").alias("words"))
    w = F.col("words")
    d = d.select(
        "*",
        F.size(w).alias("n"),
        F.length(F.array_join("words", "")).alias("in_words"),
        # equal 64-bit hashes stand for equal triples within one text
        F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))).alias("tri"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x.isin(WORDS)).alias("common"),
        # white space is what the words leave, so one pass takes out the two commonest classes in long runs
        F.regexp_replace("text", r"[\p{Ll}\s]+", "").alias("r1"),
    )
    for k, (_, pattern) in enumerate(CLASSES[2:], 2):
        d = d.withColumn(f"r{k}", F.regexp_replace(f"r{k - 1}", pattern, ""))
    blank = F.length("text") - F.col("in_words")
    left = [F.length("text") - blank, *(F.length(f"r{k}") for k in range(1, len(CLASSES))), F.lit(0)]
    lower, *rest = [(a - b).cast("long") for a, b in zip(left, left[1:], strict=False)]
    chars = F.array(lower, blank.cast("long"), *rest)
    common = F.array(*((F.size("common") - F.size(F.array_remove("common", v))).cast("long") for v in WORDS), F.greatest(F.col("n") - F.size("common"), F.lit(0)).cast("long"))  # the last: all other words
    repeated = F.when(F.size(F.array_distinct("tri")) < F.size("tri"), F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.select(
        *kept,
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.col("in_words").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("sorted"),
        chars.alias("chars"),
        F.length("text").cast("long").alias("n_chars"),
        common.alias("hist"),
        F.greatest(F.col("n"), F.size("common")).cast("long").alias("n_hist"),
    )
    s = F.col("sorted")
    starts = F.sort_array(F.transform(F.filter(F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda x: x.isNotNull()), lambda x: x))
    d = d.withColumn("starts", starts).drop("sorted")
    st = F.col("starts")
    covered = F.aggregate(F.transform(st, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(st, i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("starts")


def distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (base 2) of an array of counts, which sum to ``total``, from shares; null without counts or
    shares. A bin without a count adds half its share, and all shares sum to 1, so only bins with counts are worked out."""

    def term(x, q):
        p = x / total
        return p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0) - q

    terms = F.filter(F.zip_with(counts, shares, lambda x, q: F.when(x > 0, term(x, q))), lambda t: t.isNotNull())
    return F.when((total > 0) & F.get(shares, 0).isNotNull(), F.sqrt(F.greatest((F.aggregate(terms, F.lit(0).cast("double"), lambda a, x: a + x) + 1) / 2, F.lit(0.0))))


def references(f: DataFrame) -> DataFrame:
    """(ref_lang, ref_chars, ref_words): a row a language, the shares of the summed histograms of documents that pass the
    base rules. Counts are summed before the shuffle, so a language costs a row a task."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.sum(F.get("hist", F.lit(i))).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    ref = f.where(~F.col("base_failed")).groupBy("lang").agg(*sums)

    def shares(prefix):
        names = [c for c in ref.columns if c.startswith(prefix) and c != "lang"]
        total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
        return F.array(*(F.col(c) / F.nullif(total, F.lit(0)) for c in names))

    return ref.select(F.col("lang").alias("ref_lang"), shares("c").alias("ref_chars"), shares("w").alias("ref_words"))


def judge(docs: DataFrame, *, keep: list[str], lang_col: str = "lang", text_col: str = "text", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``keep`` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance and kept.

    Null and empty texts have no words and fail the base rules; very long ones are read whole; a null language is a
    language of its own; distances are null where a guard holds or a language has no reference, and a null distance never
    rejects. Rows repeat as given; no rows, no rows. A kept column with a result's name is replaced by the result.

    The documents stay where they are read: the references, a row a language, are counted and then broadcast.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    keep = [c for c in keep if c.lower() not in results]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    f = stored(features(docs, keep, lang_col, text_col).withColumn("base_failed", base), "rules")
    ref = stored(references(f), "references")
    j = f.join(F.broadcast(ref) if ref.count() <= MAX_BROADCAST else ref, F.col("lang") == F.col("ref_lang"), "left")
    char = F.when(F.col("n_chars") >= MIN_CHARS, distance(F.col("chars"), F.col("n_chars"), F.col("ref_chars")))
    word = F.when(F.col("n_words") >= MIN_COMPARED, distance(F.col("hist"), F.col("n_hist"), F.col("ref_words")))
    j = j.withColumn("char_distance", char).withColumn("word_distance", word)
    good = (F.coalesce("char_distance", F.lit(0.0)) <= max_char) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return j.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *results[:5], "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & good).alias("kept"))
