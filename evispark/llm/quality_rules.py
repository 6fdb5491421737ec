"""Line-first quality rules, written with SQL functions only.

Every line of a document is judged by three rules (punctuation, navigation, boilerplate); lines that
fail are removed, and a document that loses too much of its text is rejected, as is one that fails the
base rules (too few words, too many repeated three-word windows). A phrase marks a line of at most ``BOILERPLATE_CHARS`` as
boilerplate, and a menu's word one of at most ``MENU_CHARS``: longer lines are prose that mentions it, and stay.

Defined results: a null or empty text has no words, fails the base rules and gives the cleaned text
``''``; repeated rows are judged alike; other columns of any name are kept, but ``quality_rules`` replaces
one with the name of a result (``kept_documents`` keeps it); an empty table gives an empty table with the
same columns. Every step is local to its row, so no row moves between tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.columns import at, by_place, named

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# Phrases that mark a line as boilerplate, and the words that menus are made of.
BOILERPLATE = (
    "all rights reserved",
    "copyright ©",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "we use cookies",
    "accept cookies",
    "enable javascript",
    "lorem ipsum",
    "powered by wordpress",
    "subscribe to our newsletter",
)
NAVIGATION = ("home", "menu", "login", "log in", "sign in", "sign up", "next", "previous", "search", "contact us", "about us", "back to top", "read more", "share this")

RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "cleaned", "lost_chars", "base_failed", "kept"]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
#: Runs of symbols or of doubled exclamation and question marks per hundred characters of a line.
MAX_MARKS_PERCENT = 4
#: Separators, such as a bar between spaces, per hundred characters of a line.
MAX_SEPARATORS_PERCENT = 3
SEPARATORS = "|›»·•"
#: Longest line that can be a menu entry, and longest that one boilerplate phrase condemns.
MENU_CHARS = 24
BOILERPLATE_CHARS = 200


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(spans: str) -> Column:
    """Words inside three-word windows seen twice or more; ``spans`` names the sorted (hash, position) array."""
    s = F.col(spans)
    twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def symbols_in(text: Column) -> Column:
    """Number of symbols; each is one byte, so the bytes that their removal saves."""
    bare = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), "#*$%&|<>", text)
    return F.octet_length(text) - F.octet_length(bare)


def line_fails(line: Column) -> Column:
    """True for a line with words that breaks a punctuation, navigation or boilerplate rule.

    The cheap test of each rule stands first: the regular expression behind it is rarely reached.
    """
    size, low = F.char_length(line), F.lower(line)
    unpunctuated = ~line.contains(".") & ~line.rlike(r"[!?…。！？।؟]") & line.rlike(r"[^\x20\x09-\x0D]")
    marks = F.regexp_count(line, F.lit(SYMBOLS + r"+|[!?]{2,}")) * 100 > size * MAX_MARKS_PERCENT
    separated = any_of([line.contains(c) for c in SEPARATORS]) & (F.regexp_count(line, F.lit(r"(?<![^\s])[" + SEPARATORS + r"](?![^\s])")) * 100 > size * MAX_SEPARATORS_PERCENT)
    menu = (size <= MENU_CHARS) & low.rlike(r"^\W*(" + "|".join(NAVIGATION) + r")\W*$")
    boilerplate = (size <= BOILERPLATE_CHARS) & any_of([low.contains(x) for x in BOILERPLATE])
    return unpunctuated | menu | boilerplate | separated | marks


def quality_rules(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Adds the counts, the verdicts and ``cleaned`` (the text without its failed lines) to every row.

    ``max_lost_percent``: a document whose removed lines hold more than this share of its characters is
    not kept. Blank lines are neither judged nor counted as lost.
    """
    return judged(by_place(docs), at(docs, text), max_lost_percent).select(*named(docs, RESULTS))


def judged(docs: DataFrame, text: Column, max_lost_percent: int) -> DataFrame:
    """docs, whose columns are named by place, with the results."""
    body = F.coalesce(text, F.lit(""))
    lines = F.split(body, "\n")
    out = docs.withColumns({"__words": words_of(body), "__lines": lines, "__good": F.filter(lines, lambda x: ~line_fails(x))})
    w, n = F.col("__words"), F.size("__words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("__h", windows)
    h = F.col("__h")
    spans = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i")))))
    filled = F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({"__s": spans, "__filled": filled})
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": symbols_in(body).cast("long"),
            "n_dup_lines": (F.size("__filled") - F.size(F.array_distinct("__filled"))).cast("long"),
            "n_repeat_words": F.when(F.col("__s").isNull(), 0).otherwise(repeated_words("__s")).cast("long"),
            "n_lines_removed": (F.size("__lines") - F.size("__good")).cast("long"),
            "cleaned": F.array_join("__good", "\n"),
            "__all": F.char_length(F.array_join("__lines", "")),
        }
    )
    out = out.withColumn("lost_chars", (F.col("__all") - F.char_length(F.replace("cleaned", F.lit("\n"), F.lit("")))).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("__all") * max_lost_percent))


def kept_documents(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The rows that are kept, with the columns of docs and their cleaned text.

    Rejected rows leave through an inlined array and not through a filter: a filter would be pushed below the
    projections and there repeat every expression that the verdict rests on.
    """
    rows = judged(by_place(docs), at(docs, text), max_lost_percent)
    row = F.struct(*[(F.col("cleaned") if c == text else F.col(f"c{k}")).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    return rows.select(F.inline(F.when(F.col("kept"), F.array(row)))).toDF(*docs.columns)
