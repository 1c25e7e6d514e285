"""Text as column expressions: tokens, n-grams, similarity, snippets, ratios, ids. All run inside the JVM but where said."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Token patterns that results depend on.
ANALYZER_TOKEN = r"[0-9A-Za-z가-힣_./:@+-]+"
BM25_TOKEN = r"[0-9A-Za-z]+|[가-힣]+"
CONTENT_TOKEN = r"[0-9A-Za-z]{2,}|[가-힣]{2,}"
KEYWORD_TOKEN = r"[0-9A-Za-z가-힣]{2,}"
HANGUL = r"[가-힣]+"

#: Endings that are cut off keywords, the first that fits, and words that only ask.
PARTICLES = ("으로", "에서", "까지", "에게", "보다", "처럼", "은", "는", "이", "가", "을", "를", "의", "에", "로", "와", "과", "도")
QUESTION_WORDS = ("언제", "어디", "무엇", "누구", "어떤", "어떻게", "알려줘", "확인", "내야", "해야", "뭐야")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matches(text: Column | str, pattern: str) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(c(text), F.lit(pattern), F.lit(0))


def collapse(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c(text), r"\s+", " "))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else " ".join(unicodedata.normalize("NFKC", t.replace("\x00", " ")).split()) for t in text], dtype="object")


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold() for t in text], dtype="object")


#: Texts of these characters alone are their own NFKC form; others go to Python, an Arrow batch at a time, as Spark has no NFKC.
ASCII = r"^[\x00-\x7F]*$"
#: What Python takes for white space among them.
BLANKS = r"[\x09-\x0D\x1C-\x20]+"


def normalize_text(text: Column | str) -> Column:
    """NFKC with NUL as a blank and white space collapsed."""
    plain = F.trim(F.regexp_replace(F.translate(c(text), "\x00", " "), BLANKS, " "))
    return F.when(c(text).rlike(ASCII), plain).otherwise(_nfkc(F.when(~c(text).rlike(ASCII), c(text))))


def normalize_name(text: Column | str) -> Column:
    """NFKC, collapsed and case-folded: the form that entity names are compared in."""
    plain = F.lower(F.trim(F.regexp_replace(c(text), BLANKS, " ")))
    return F.when(c(text).rlike(ASCII), plain).otherwise(_folded(F.when(~c(text).rlike(ASCII), c(text))))


def stable_id(prefix: str, namespace: str, value: Column | str) -> Column:
    """prefix_ and 32 hex digits of SHA-256 over namespace, NUL and value."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit(namespace), F.lit("\x00"), c(value).cast("string")), 256), 1, 32))


def ngrams(run: Column, n: int) -> Column:
    """All runs of n characters, in order; none of a shorter text."""
    size = F.length(run)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - (n - 1))), lambda i: run.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def analyzer_tokens(text: Column | str, low: int = 2, high: int = 4) -> Column:
    """Index tokens, each once, by first place: tokens, and for each Hangul run in one the run and its n-grams."""

    def of_run(run: Column) -> Column:
        return F.flatten(F.array(F.array(run), *[ngrams(run, n) for n in range(low, high + 1)]))

    def of_token(token: Column) -> Column:
        runs = F.flatten(F.transform(matches(token, HANGUL), of_run))
        return F.concat(F.array(token), runs)

    tokens = matches(F.lower(collapse(text)), ANALYZER_TOKEN)
    return F.when(c(text).rlike(HANGUL), F.array_distinct(F.flatten(F.transform(tokens, of_token)))).otherwise(F.array_distinct(tokens))


def bm25_tokens(text: Column | str) -> Column:
    """Ranking tokens, repeats kept: words lower-cased; Hangul runs over two letters with their bigrams behind them."""

    def of_run(run: Column) -> Column:
        long = run.rlike(HANGUL) & (F.length(run) > 2)
        return F.when(long, F.concat(F.array(run), ngrams(run, 2))).otherwise(F.array(run))

    tokens = matches(F.lower(c(text)), BM25_TOKEN)
    return F.when(c(text).rlike(HANGUL), F.flatten(F.transform(tokens, of_run))).otherwise(tokens)


def content_tokens(text: Column | str) -> Column:
    return F.array_distinct(matches(F.lower(c(text)), CONTENT_TOKEN))


def keywords(text: Column | str) -> Column:
    """Words of two letters or more without their particle, and without words that only ask."""

    def stem(word: Column) -> Column:
        out = F.when(F.lit(False), word)
        for p in PARTICLES:
            out = out.when(word.endswith(p) & (F.length(word) - len(p) >= 2), F.substring(word, F.lit(1), F.length(word) - len(p)))
        return out.otherwise(word)

    return F.array_distinct(F.array_except(F.transform(matches(F.lower(c(text)), KEYWORD_TOKEN), stem), F.array(*map(F.lit, QUESTION_WORDS))))


def bigrams(text: Column | str) -> Column:
    return F.array_distinct(ngrams(F.array_join(matches(F.lower(c(text)), KEYWORD_TOKEN), ""), 2))


def relevant(query: Column | str, body: Column | str) -> Column:
    """Two keywords of the query (or its only one) occur in the body; without keywords half of the query's bigrams do."""
    words, low = keywords(query), F.lower(c(body))
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    pairs = bigrams(query)
    shared = F.size(F.array_intersect(pairs, bigrams(body))) / F.nullif(F.size(pairs), F.lit(0))
    return F.when(F.size(words) > 0, hits >= F.least(F.lit(2), F.size(words))).otherwise(F.coalesce(shared >= 0.5, F.lit(False)))


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of lower-case words, two blanks before and one behind each."""
    words = F.filter(F.split(F.lower(c(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: ngrams(p, 3))))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0)), F.lit(0.0))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs without overlap; an empty term never."""
    size = F.octet_length
    return F.when(size(term) > 0, (size(text) - size(F.replace(text, term, F.lit("")))) / size(term)).otherwise(0).cast("int")


def snippet(body: Column | str, terms: Column, width: int = 360) -> Column:
    """A window of the collapsed body that starts a third of its width before the first term, dots where it is cut."""
    flat = collapse(body)
    low = F.lower(flat)
    places = F.filter(F.transform(F.filter(terms, lambda t: F.length(t) > 0), lambda t: F.instr(low, F.lower(t)) - 1), lambda p: p >= 0)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(places), F.lit(0)) - F.when(F.size(places) > 0, F.lit(width // 3)).otherwise(0))
    cut = F.substring(flat, start + 1, F.lit(width))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(start + width < F.length(flat), "…").otherwise(""))


def prefix_snippet(body: Column | str, width: int = 500) -> Column:
    return F.substring(collapse(body), 1, width)


def ratio(text: Column | str, pattern: str) -> Column:
    """The share of characters that match a character class; 0 for an empty text."""
    t = c(text)
    return F.when(F.length(t) > 0, (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / F.length(t)).otherwise(0.0)


#: What isn't printable, apart from newline and tab: controls, formats, surrogates, private use, unassigned, other spaces.
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}   -   　&&[^\n\t]]"


def printable_ratio(text: Column | str) -> Column:
    return F.when(F.length(c(text)) > 0, 1.0 - ratio(text, UNPRINTABLE)).otherwise(0.0)


def hangul_ratio(text: Column | str) -> Column:
    return ratio(text, r"[가-힣]")


def replacement_ratio(text: Column | str) -> Column:
    return ratio(text, "�")


def extraction_quality(text: Column | str, warnings: Column | int = 0) -> Column:
    """Length to 2000 characters (0.4), printable (0.3) and Hangul (0.3, full at a third), less 0.03 a warning, 0.3 at most."""
    w = warnings if isinstance(warnings, Column) else F.lit(warnings)
    loss = F.greatest(F.lit(0.0), F.least(F.lit(0.3), w * F.lit(0.03)))
    score = 0.4 * F.least(F.lit(1.0), F.length(c(text)) / 2000) + 0.3 * printable_ratio(text) + 0.3 * F.least(F.lit(1.0), hangul_ratio(text) * 3) - loss
    return F.when(F.length(c(text)) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0)


def ocr_reason(text: Column | str) -> Column:
    """Why a page's text should be read by OCR; null if it needn't."""
    t = F.regexp_replace(F.coalesce(c(text), F.lit("")), r"[ \t\n\r]", "")
    return (
        F.when(F.length(t) < 20, "low_text")
        .when(ratio(t, r"\p{Co}") >= 0.2, "high_pua")
        .when(ratio(t, r"[\x00-\x1f\x7f-\x9f]") >= 0.05, "high_control")
        .when(replacement_ratio(t) >= 0.05, "high_replacement")
    )


def embedding_text(title: Column | str, body: Column | str, limit: int) -> Column:
    """Title and body; if too long, its head and tail with dots between."""
    whole = F.concat_ws("\n", F.nullif(c(title), F.lit("")), c(body))
    room = limit - 3
    head = (room + 1) // 2
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.substring(whole, 1, head), F.lit("\n…\n"), F.right(whole, F.lit(max(0, room - head)))))


def capped_terms(terms: Column, most: int = 64) -> Column:
    """Distinct terms, the longest ``most`` of them in their order."""
    own = F.array_distinct(terms)
    ranked = F.transform(own, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    kept = F.transform(F.slice(F.array_sort(ranked), 1, most), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t")))
    return F.transform(F.array_sort(kept), lambda x: x["t"])


def blank_or_symbols(query: Column | str) -> Column:
    """Queries that hold no letter or digit, and so ask nothing."""
    return ~F.coalesce(c(query), F.lit("")).rlike(r"[\p{L}\p{N}]")


def any_of(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))
