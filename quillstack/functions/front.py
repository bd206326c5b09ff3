"""Title and authors from the first lines of a document, as column expressions.

Lines become an array of records, each with what the line shows: its people, whether it lists people, whether it ends what stands
before. Title and names are then slices of that array between the first places of such marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import strip_all

# Patterns and words that tell what a line of front matter is.
EMAIL = r"[\w.+-]+@[\w.-]+\.\w+"
LINK = r"(?i)https?://\S+"
PAGE_MARK = r"<!--\s*page:\d+\s*-->"
PAGE_LINE = r"(?i)^\s*page\s*\d+\s*$"
IDENTIFIER = r"(?i)^(arxiv|doi|http|www\.|proceedings|preprint)"
ABSTRACT = r"(?i)^(?:\d+\.?\s*)?(?:abstract|摘要|summary)\s*[:.]?\s*$|^(?:\d+\.?\s+)?introduction\b"
NOTE_MARKS = r"[\d†‡§*∗]+"
PLACES = (
    "university", "institute", "department", "laboratory", "lab", "college", "school", "research center", "research centre", "academy", "center for", "centre for",
    "corporation", "inc", "ltd", "microsoft", "google", "deepmind", "openai", "facebook", "amazon", "arxiv", "eth zurich", "tsinghua", "peking university",
)
FUNCTION_WORDS = ("a", "an", "the", "and", "or", "for", "to", "of", "in", "on", "from", "with", "via", "using", "towards", "toward", "over", "under", "how", "what", "why", "when")
# Characters read; lines looked at, lines and characters taken.
READ = 4000
TITLE_REACH, TITLE_LINES, TITLE_CHARS, LONG_LINE, NOTED_LINE, SHORT_LINE = 25, 4, 200, 180, 80, 3
BYLINE_REACH, BYLINE_CHARS, NAMES, AUTHOR_CHARS = 40, 160, 30, 300
SAME_BEGINNING, GIVEN_LEAST, OWN_LONGER, FALLBACK_LEAST, FALLBACK_LONGER = 24, 8, 8, 6, 4

PLACE = rf"(?i)\b({'|'.join(PLACES)})\b"
#: A word of a name: a capital, then a small letter somewhere, or no further letter at all.
_WORD = r"[A-ZÀ-Þ](?:\S*[a-zß-ÿ]\S*|[^A-Za-zÀ-ÿ\s]+)"
_NAME = rf"^{_WORD}(?: {_WORD}){{1,3}}$"
_BEGINS_AS_NAME = rf"^{_WORD} \S"
_FUNCTION = rf"(?i)(?<!\S)({'|'.join(FUNCTION_WORDS)})(?!\S)"


def _tidy(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^[ ,;.]+|[ ,;.]+$", "")


def _clean(line: Column) -> Column:
    bare = F.regexp_replace(F.translate(line, "\u00a0\ufeff", " "), PAGE_MARK, "")
    return F.when(bare.rlike(PAGE_LINE), "").otherwise(strip_all(bare))


def _people(line: Column) -> Column:
    """The pieces of a list of people, family names behind given ones."""
    listed = _tidy(F.regexp_replace(line, NOTE_MARKS, " "))
    turned = F.transform(F.split(listed, ";"), lambda p: F.regexp_replace(p, "^([^,]*),(.*)$", "$2 $1"))
    return F.filter(F.transform(F.when(F.contains(listed, F.lit(";")), turned).otherwise(F.split(listed, ",")), _tidy), lambda p: p != "")


def _words(piece: Column) -> Column:
    """A piece as its words: hyphens open, points at their ends gone."""
    return F.regexp_replace(F.replace(piece, F.lit("-"), F.lit(" ")), r"[.,;:]+(?= |$)|(?<![^ ])[.,;:]+", "")


def is_name(piece: Column) -> Column:
    """Two to four words of names, none a place or a function word."""
    w = _words(piece)
    return w.rlike(_NAME) & ~w.rlike(PLACE) & ~w.rlike(_FUNCTION) & ~piece.rlike(EMAIL)


def lines(front: Column) -> Column:
    """The lines as records (t, people): text without marks of pages, and the pieces of a list of people."""
    breaks = r"\r\n|[\n\r\f\x0b\x1c-\x1e\u0085\u2028\u2029]"
    return F.transform(F.split(F.coalesce(F.substring(front, 1, READ), F.lit("")), breaks), lambda x: F.struct(_clean(x).alias("t")))


def shown(line: Column) -> Column:
    """What a cleaned line shows: skip (before a title), stop (ends title and names), heading (the text begins), noted, byline, names."""
    t = line["t"]
    stop = t.rlike(ABSTRACT) | t.rlike(EMAIL) | t.rlike(PLACE)
    people = line["people"]
    named = F.size(F.filter(people, is_name))
    apart = stop | t.rlike(LINK) | t.rlike("^[{†*]") | (F.length(t) > BYLINE_CHARS)
    several = (named >= 2) & (named >= F.size(people) - 1)
    single = (named == 1) & (F.size(people) == 1) & t.rlike(NOTE_MARKS)
    taken = F.filter(people, lambda p: is_name(p) | _words(p).rlike(_BEGINS_AS_NAME))
    return F.struct(
        t.alias("t"), ((F.length(t) < SHORT_LINE) | t.rlike(r"^[\d\s\-.]+$") | t.rlike(IDENTIFIER)).alias("skip"), stop.alias("stop"), t.rlike(ABSTRACT).alias("heading"), t.rlike(NOTE_MARKS).alias("noted"),
        (~apart & (several | single)).alias("byline"), taken.alias("names"), t.rlike("^[{†]").alias("note"),
    )


def _first(flags: Column, otherwise: Column) -> Column:
    """Place from 0 of the first true flag."""
    at = F.array_position(flags, True)
    return F.when(at > 0, at - 1).otherwise(otherwise).cast("int")


def _from(lines_: Column, at: Column) -> Column:
    return F.filter(lines_, lambda x, i: i >= at)


def read_front(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _title and _names, the title's lines joined and the names of the lines that list people."""
    step = docs.withColumn("_l", lines(F.col(text_col)))
    step = step.withColumn("_l", F.transform("_l", lambda x: F.struct(x["t"].alias("t"), _people(x["t"]).alias("people"))))
    step = step.withColumn("_l", F.transform("_l", shown))
    step = step.withColumn("_l", _from(F.col("_l"), _first(F.transform("_l", lambda x: ~x["skip"]), F.size("_l"))))
    # A title's line is the first one or follows one: blank lines, marks on short lines, people, and what stops end it.
    over = lambda x, i: x["stop"] | x["byline"] | (x["t"] == "") | F.when(i == 0, (F.length(x["t"]) > LONG_LINE) | x["t"].rlike("(?i)^keywords")).otherwise(x["noted"] & (F.length(x["t"]) < NOTED_LINE))
    step = step.withColumn("_end", _first(F.transform("_l", over), F.size("_l")))
    own = F.slice(F.filter(F.slice("_l", 1, F.least("_end", F.lit(TITLE_REACH))), lambda x: F.length(x["t"]) >= SHORT_LINE), 1, TITLE_LINES)
    title = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["t"]), " "), r"(?U)\s+", " "), "^[ \\-–—·]+|[ \\-–—·]+$", "")
    # People are named above the abstract: below its heading a line like theirs is text.
    reach = F.least(_first(F.transform("_l", lambda x: x["heading"]), F.size("_l")), F.lit(BYLINE_REACH))
    step = step.withColumn("_title", title).withColumn("_at", _first(F.transform(F.slice("_l", F.lit(1), reach), lambda x: x["byline"]), F.size("_l")))
    step = step.withColumn("_l", F.slice(_from(F.col("_l"), F.col("_at")), 1, BYLINE_REACH))
    step = step.withColumn("_end", _first(F.transform("_l", lambda x: x["stop"] | x["note"] | (F.size(x["names"]) == 0)), F.size("_l")))
    names = F.slice(F.array_distinct(F.flatten(F.transform(F.slice("_l", 1, F.col("_end")), lambda x: x["names"]))), 1, NAMES)
    return step.withColumn("_names", names).drop("_l", "_end", "_at")


def reconciled(own: Column, given: Column) -> Column:
    """The title read from the page against one given: of two that begin alike the longer one, else the given one unless the own one
    says clearly more; a very short given one does not count."""
    given = strip_all(F.coalesce(given, F.lit("")))
    begins = lambda a, b: F.startswith(F.lower(a), F.lower(F.substring(b, 1, SAME_BEGINNING)))
    longer = F.when(F.length(own) >= F.length(given), own).otherwise(given)
    best = F.when(own == "", F.when(given == "", "untitled").otherwise(given)).when(F.length(given) < GIVEN_LEAST, own).when(begins(own, given) | begins(given, own), longer)
    return F.substring(best.when(F.length(own) > F.length(given) + OWN_LONGER, own).otherwise(given), 1, TITLE_CHARS)


def given_first(own: Column, given: Column) -> Column:
    """The fallback's rule: a given title of more than a few characters stays, unless the reconciled one is longer by more than four."""
    bare, other = strip_all(F.coalesce(given, F.lit(""))), reconciled(own, given)
    better = (other != "untitled") & (F.length(other) > F.length(bare) + FALLBACK_LONGER)
    return F.when((F.length(bare) > FALLBACK_LEAST) & ~better, F.substring(bare, 1, TITLE_CHARS)).otherwise(other)


def front_matter(docs: DataFrame, id_col: str = "id", text_col: str = "text", title_col: str | None = None, author_col: str | None = None, fallback: bool = False) -> DataFrame:
    """(paper_id, title, authors) from the first 4000 characters; fallback takes the rule that prefers the given title."""
    none = F.lit(None).cast("string")
    given = docs.select(F.col(id_col).cast("long").alias("paper_id"), F.col(text_col).alias("text"), (F.col(title_col) if title_col else none).alias("gt"), (F.col(author_col) if author_col else none).alias("ga"))
    rule = given_first if fallback else reconciled
    authors = F.coalesce(F.nullif(strip_all(F.col("ga")), F.lit("")), F.array_join("_names", "; "))
    return read_front(given).select("paper_id", rule(F.col("_title"), F.col("gt")).alias("title"), F.substring(authors, 1, AUTHOR_CHARS).alias("authors"))
