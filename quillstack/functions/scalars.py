"""Scalar functions of the library as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"
_BLANK = "[ \\t\\n\\x0B\\f\\r]+"


def _s(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_empty(c: Column | str) -> Column:
    return F.coalesce(_s(c), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_s(c), f"^{_BLANK}|{_BLANK}$", "")


def is_blank(c: Column | str) -> Column:
    return F.trim(blank_to_empty(c)) == ""


def norm_title(c: Column | str) -> Column:
    """Lower case, only a-z, 0-9 and CJK characters kept."""
    return F.regexp_replace(F.lower(_s(c)), f"[^a-z0-9{CJK}]", "")


def norm_name(c: Column | str) -> Column:
    """Trimmed, blanks collapsed, lower case."""
    return F.lower(F.regexp_replace(strip(c), _BLANK, " "))


def titles_match(a: Column, b: Column, least: int = 12, parity: bool = False) -> Column:
    """Whether the shorter normalised title (of `least` characters at least) stands in the other.

    parity takes the alphabetically smaller title for the shorter one.
    """
    a, b = norm_title(a), norm_title(b)
    short = F.least(a, b) if parity else F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.greatest(a, b) if parity else F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.length(short) >= least) & F.contains(long, short)


def index_text(title, authors, topics, abstract, summary) -> Column:
    """The searchable text of a paper: its fields joined by ` / `, without slashes and blanks at the ends."""
    return F.regexp_replace(F.concat_ws(" / ", *[blank_to_empty(c) for c in (title, authors, topics, abstract, summary)]), "^[ /]+|[ /]+$", "")


def topic_list(c: Column | str, most: int = 24, width: int = 48) -> Column:
    """Topics of a raw string: split, tidied, cut to width, first spelling of each kept, at most `most`."""
    items = F.filter(F.transform(F.split(blank_to_empty(c), "[;,，、|]+"), lambda x: F.substring(strip(F.regexp_replace(x, _BLANK, " ")), 1, width)), lambda x: x != "")
    lowered = F.transform(items, F.lower)
    first = F.filter(F.transform(items, lambda x, i: F.when(F.array_position(lowered, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.slice(first, 1, most)


def normalize_topics(c: Column | str) -> Column:
    return F.array_join(topic_list(c), "; ")


def parse_topics(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(blank_to_empty(c), ";"), strip), lambda x: x != "")


def format_authors(c: Column | str, shown: int = 3, suffix: str = " et al.") -> Column:
    names = parse_topics(c)
    return F.concat(F.array_join(F.slice(names, 1, shown), "; "), F.when(F.size(names) > shown, suffix).otherwise(""))


def extract_doi(c: Column | str) -> Column:
    """The first DOI in the first 4000 characters, else one made from an arXiv id, else empty."""
    front = F.substring(_s(c), 1, 4000)
    doi = F.regexp_replace(F.regexp_extract(front, "10\\.[0-9]{4,9}/[^ \\t\\n\\x0B\\f\\r\"'<>\\])]+", 0), "[.,;)]+$", "")
    arxiv = F.regexp_extract(front, "(?i)arxiv[: \\t\\n\\r]*([0-9]{4}\\.[0-9]{4,5})", 1)
    return F.when(doi != "", doi).when(arxiv != "", F.concat(F.lit("10.48550/arXiv."), arxiv)).otherwise("")


def extract_year(text: Column | str, date: Column | str | None = None) -> Column:
    """Year of the date given, else of an arXiv id, else the first 19xx or 20xx in 2000 characters; null if none."""
    year = "\\b((?:19|20)[0-9]{2})\\b"
    part = lambda c, p: F.expr("cast(null as int)") if c is None else F.try_to_number(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.lit("9999")).cast("int")
    from_id = part(F.substring(_s(text), 1, 4000), "(?i)arxiv[: \\t\\n\\r]*([0-9]{2})[0-9]{2}\\.[0-9]{4,5}")
    return F.coalesce(part(None if date is None else blank_to_empty(date), year), from_id + 2000, part(F.substring(_s(text), 1, 2000), year))


def catalog_year(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(blank_to_empty(c), "(1[5-9][0-9]{2}|20[0-9]{2})", 1), F.lit("")).cast("int")


def extract_abstract(c: Column | str) -> Column:
    found = F.regexp_extract(_s(c), "(?is)abstract[:.\\s—-]*(.{80,2500}?)(?:\\n#|\\n\\s*\\n\\s*(?:1|introduction|keywords|index terms)\\b)", 1)
    return F.substring(strip(F.regexp_replace(found, _BLANK, " ")), 1, 1200)


# Words that are no topics.
STOP_WORDS = """the a an and or of for to in on with via using from by at as is are be we our their this that these those
towards toward how what when where which can do does not into over under based paper study approach method methods
model models system systems framework frameworks""".split()


_LATIN = "[A-Za-z][A-Za-z0-9+\\-.]{2,}"


def raw_tokens(c: Column | str) -> Column:
    """Latin words of three characters and more, then runs of 2 to 8 CJK characters."""
    text = blank_to_empty(c)
    return F.concat(F.regexp_extract_all(text, F.lit(_LATIN), 0), F.regexp_extract_all(text, F.lit(f"[{CJK}]{{2,8}}"), 0))


def topic_term(token: Column | str) -> Column:
    """A raw token without dots and dashes at its ends; null for stop words and what is short then."""
    t = F.btrim(_s(token), F.lit(".-"))
    latin = F.ascii(t).between(1, 127)
    return F.when(~latin | ((F.length(t) >= 3) & ~F.lower(t).isin(STOP_WORDS)), t)


def topic_tokens(c: Column | str) -> Column:
    """The terms of a text, in order: latin ones, then CJK ones."""
    return F.filter(F.transform(raw_tokens(c), topic_term), lambda x: x.isNotNull())


def safe_filename(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(_s(c), f"(?U)[^\\w{CJK}.-]+", "_"), 1, 60)


def strip_all(c: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(_s(c), "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def query_terms(c: Column | str) -> Column:
    """search_terms() of a column."""
    return F.filter(F.split(_s(c), "(?U)[\\s\\x1c-\\x1f,，;；、|]+"), lambda t: F.length(t) >= 3)


def search_terms(query: str) -> list[str]:
    """Terms of a query for substring search: pieces of three characters at least."""
    import re

    return [t for t in re.split(r"[\s,，;；、|]+", query.strip()) if len(t) >= 3]


def external_id(doi, arxiv, corpus, title) -> Column:
    """doi:…, else arxiv:…, else corpus:…, else th: and 16 hex digits of the lower-cased title's SHA-1."""
    have = lambda c: F.when(~is_blank(c), _s(c))
    return F.coalesce(F.concat(F.lit("doi:"), have(doi)), F.concat(F.lit("arxiv:"), have(arxiv)), F.concat(F.lit("corpus:"), have(corpus)), F.concat(F.lit("th:"), F.substring(F.sha1(F.lower(blank_to_empty(title)).cast("binary")), 1, 16)))


def work_id(doi: Column | str, url: Column | str) -> Column:
    """Identifier of a citation API's work: bare DOI, else openalex: and the URL's last part."""
    bare = F.regexp_replace(blank_to_empty(doi), "^https?://doi\\.org/", "")
    return F.when(bare != "", bare).otherwise(F.concat(F.lit("openalex:"), F.element_at(F.split(blank_to_empty(url), "/"), -1)))


def norm_doi(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(blank_to_empty(c))), "^doi:", "")


def loose_json(c: Column | str, schema: str) -> Column:
    """from_json, once more on what ends at the last brace if that fails."""
    whole = F.from_json(_s(c), schema)
    cut = F.from_json(F.regexp_extract(_s(c), "(?s)^(.*\\})", 1), schema)
    return F.coalesce(whole, cut)


def quota_error(status: Column, body: Column) -> Column:
    return F.coalesce(status == 402, F.lit(False)) | F.coalesce(F.lower(body).rlike("quota|insufficient|balance|credit|payment"), F.lit(False))


def pages_label(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "").when(last.isNull() | (first == last), F.concat(F.lit("p"), first.cast("string"))).otherwise(F.concat(F.lit("p"), first.cast("string"), F.lit("-"), last.cast("string")))


def html_text(c: Column | str) -> Column:
    """Text for a page: markup characters as entities, null as empty."""
    out = F.replace(blank_to_empty(c), F.lit("&"), F.lit("&amp;"))
    for plain, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def lighten(color: Column | str, amount: float) -> Column:
    """A colour #rrggbb, each channel moved towards white by a share of what is left, rounded."""
    channel = lambda k: F.conv(F.substring(_s(color), 2 + 2 * k, 2), 16, 10).cast("int")
    hexed = lambda v: F.lpad(F.lower(F.hex(F.floor(v + (255 - v) * amount + 0.5).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), *[hexed(channel(k)) for k in range(3)])


# Fixed values from here on: sizes, widths and limits of the graph views.


def node_size(mode: str, cited: Column, chunks: Column) -> Column:
    """Size of a paper's node in the graph view."""
    if mode == "citations":
        return 9 + F.least(F.sqrt(F.coalesce(cited, F.lit(0))) * 2.2, F.lit(24.0))
    if mode == "chunks":
        return 9 + F.least(F.when(F.coalesce(chunks, F.lit(0)) == 0, 1).otherwise(chunks), F.lit(60)) / 3
    return F.lit(11.0)


def concept_value(n: Column) -> Column:
    return 1.1 + F.least(n, F.lit(28)) / 5


def concept_radius(n: Column) -> Column:
    return 6.5 * F.cbrt(concept_value(n) * 0.75 / F.lit(3.141592653589793))


def concept_radius_flat(n: Column) -> Column:
    return 8 + F.least(n, F.lit(24)) * 0.9


def short_label(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def label_visible(n: Column, flagged: Column, least: int = 3) -> Column:
    return (n >= least) | flagged


def edge_width(kind: Column, weight: Column) -> Column:
    return F.when(kind == "similar", 1 + (weight - 0.55) * 8).otherwise(1.6)


def author_list(names: Column, most: int = 8) -> Column:
    """Names of an array joined by `, `, with ` …` when there are more."""
    full = F.filter(names, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.concat(F.array_join(F.slice(full, 1, most), ", "), F.when(F.size(full) > most, " …").otherwise(""))
