"""Text expressions: cleaning, tokens, metadata detection, hashes.  Built-ins wherever they can state the rule."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Function words of Portuguese and English of three letters or more (shorter ones are never tokens).
STOP_WORDS = (
    "que para com não uma por mais dos como mas foi ele das tem seu sua ser quando muito nos está também pelo pela até "
    "isso ela entre era depois sem mesmo aos ter seus quem nas esse eles estão você tinha foram essa num nem suas meu "
    "minha têm numa pelos elas havia seja qual será nós tenho lhe deles essas esses pelas este fosse dele vocês vos lhes "
    "meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas "
    "isto aquilo estou estamos estive esteve estivemos estiveram estava estávamos estavam "
    "the and that for was with are this from they which one you were her all she there would their him been has had have "
    "more when who will out said what its about into than them can only other new some time"
).split()
# Titles that open a list of references.
REFERENCE_TITLES = (
    "references", "referências", "referencias", "referências bibliográficas", "referencias bibliograficas",
    "bibliography", "literatura citada", "works cited",
)
# Function words counted to tell the language.
LANGUAGE_WORDS = {
    "pt": "de|do|da|em|para|com|como|por|referências|resumo|artigo",
    "en": "the|of|and|in|to|for|with|as|by|references|abstract|paper",
    "es": "el|la|los|las|de|en|por|con|como|resumen|referencias",
}
# Phrases in a journal's name, and openings of lines that are no title.
JOURNAL_PHRASES = ("journal of", "proceedings of", "transactions on", "annals of", "review of", "ieee", "nature", "science")
NO_TITLE = "(?i)^(ISSN|DOI|http|Volume|Vol\\.|Issue|Page|Página)"
UNKNOWN = "não identificado"
# The patterns of DOIs, years and tokens.
DOI = "10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+"
YEAR = "\\b(19\\d{2}|20[0-2]\\d)\\b"
TOKEN = "(?U)\\b[a-zA-ZÀ-ÿ]{3,}\\b"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


NFC_ROWS = 64  # texts that a worker holds as Python strings at a time


@F.arrow_udf(StringType())
def nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Canonical composition, which no built-in offers; a few texts at a time, as a batch may hold long ones."""
    for v in batches:
        for i in range(0, len(v), NFC_ROWS):
            texts = v.slice(i, NFC_ROWS).to_pylist()
            yield pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in texts], pa.string())


def normalize_text(text) -> Column:
    """NFC; no control characters; inner blanks of a line collapsed, its ends stripped."""
    t = F.regexp_replace(nfc(_col(text)), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    t = F.regexp_replace(t, "[ \\t]+", " ")
    return F.regexp_replace(t, "(?m)^ +| +$", "")


def recompose_hyphens(text) -> Column:
    """Words broken by a hyphen at a line's end become one."""
    return F.regexp_replace(_col(text), "(?U)(\\b[A-Za-zÀ-ÿ]{2,})-\\s*\\n\\s*([a-zà-ÿ]{2,}\\b)", "$1$2")


def tokens(text, min_length: int = 3, stop_words=STOP_WORDS) -> Column:
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words) & (F.length(w) >= min_length))  # a hash set


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(_col(text), F.lit("(?U)\\S+")), F.lit(0))


def sentences(text) -> Column:
    return F.split(_col(text), "(?<=[.!?])\\s+")


def first_doi(text) -> Column:
    doi = F.regexp_replace(F.regexp_extract(_col(text), DOI, 0), "[.,;]+$", "")
    return F.when(doi != "", doi)


def first_year(text, this_year: int = 2100, creation_date=None) -> Column:
    """The PDF's date, else a year after a publication word or another year in one line, else the first plausible year
    of the first 1500 characters."""
    t = _col(text)
    pub = F.regexp_extract(t, "(?i)(?:Published|Accepted|Copyright|©|\\b19\\d{2}\\b|\\b20\\d{2}\\b)[^\\n]*?(19\\d{2}|20[0-2]\\d)", 1)
    years = F.regexp_extract_all(F.substring(t, 1, 1500), F.lit(YEAR), F.lit(1))
    usable = F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: (y >= 1900) & (y <= this_year))
    found = F.coalesce(F.when(pub != "", pub.cast("int")), F.get(usable, F.lit(0)))
    if creation_date is None:
        return found
    made = F.when(F.length(_col(creation_date)) >= 6, F.regexp_extract(_col(creation_date), "20\\d{2}|19\\d{2}", 0))
    return F.coalesce(F.when(made != "", made.cast("int")), found)


def _lines(text) -> Column:
    return F.filter(F.transform(F.split(_col(text), "\\n"), lambda x: F.trim(x)), lambda x: x != "")


def title(text, meta_title=None, stem=None) -> Column:
    """The metadata's title, else the first long lines that are no journal header, else the file's stem."""
    good = F.filter(F.slice(_lines(text), 1, 8), lambda x: (F.length(x) > 10) & ~x.rlike(NO_TITLE))
    joined = F.aggregate(good, F.lit(""), lambda s, x: F.when(F.length(s) > 30, s).when(s == "", x).otherwise(F.concat(s, F.lit(" "), x)))
    out = F.when(joined != "", joined)
    if meta_title is not None:
        m = F.trim(_col(meta_title))
        out = F.coalesce(F.when((F.length(m) > 5) & ~F.lower(m).endswith(".pdf"), m), out)
    return out if stem is None else F.coalesce(out, F.initcap(F.replace(_col(stem), F.lit("_"), F.lit(" "))))


def authors(author) -> Column:
    a = F.trim(_col(author))
    parts = F.filter(F.transform(F.split(a, "[,;]|\\band\\b"), lambda x: F.trim(x)), lambda x: F.length(x) > 2)
    return F.when(F.length(a) > 2, parts).otherwise(F.array().cast("array<string>"))


def journal(text) -> Column:
    named = F.filter(F.slice(_lines(text), 1, 5), lambda x: F.exists(F.array(*map(F.lit, JOURNAL_PHRASES)), lambda p: F.contains(F.lower(x), p)))
    return F.coalesce(F.get(named, F.lit(0)), F.lit(UNKNOWN))


def language_counts(text) -> list[tuple[str, Column]]:
    t = F.lower(_col(text))
    return [(lang, F.regexp_count(t, F.lit(f"(?U)\\b({words})\\b"))) for lang, words in LANGUAGE_WORDS.items()]


def language(text) -> Column:
    """The language with most function words, if more than five; of equals the first of pt, en, es."""
    counts = language_counts(text)
    best = F.greatest(*(c for _, c in counts))
    out = F.when(best <= 5, F.lit(UNKNOWN))
    for lang, c in counts:
        out = out.when(c == best, F.lit(lang))
    return out


def reference_evidence(after, position, heading=None) -> Column:
    """Confidence that a heading opens the references, from the next 40 non-empty lines (an array), its page over the
    number of pages, and the heading's line; without following lines the partial score stands, unclamped."""
    rest = F.array_join(after, " ")
    base = F.lit(0.30) + F.when(position >= 0.7, 0.25).when(position >= 0.5, 0.15).otherwise(0.0)
    years = F.regexp_count(rest, F.lit(YEAR))
    brackets = F.regexp_count(rest, F.lit("\\[\\d+\\]"))
    links = F.regexp_count(rest, F.lit("(?i)10\\.\\d{4,9}/|https?://|doi:"))
    more = F.when(years >= 5, 0.25).when(years >= 2, 0.15).otherwise(0.0) + F.when((brackets >= 3) | (links >= 2), 0.20).otherwise(0.0)
    if heading is not None:
        more = more - F.when(F.length(F.trim(heading)) > 50, 0.30).otherwise(0.0)
    return F.when(rest == "", base).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + more)))


def is_reference_title(line) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(_col(line))), "^[#*\\s\\-\\d\\.]+", "")).isin(*REFERENCE_TITLES)


@F.pandas_udf(StringType())
def safe_filename(name: pd.Series) -> pd.Series:
    def one(n):
        n = unicodedata.normalize("NFKD", n or "").encode("ascii", "ignore").decode()
        n = re.sub(r"[-\s]+", "_", re.sub(r"[^\w\s-]", "", n).strip())
        return n or "documento"

    return name.map(one)


def text_hash(text) -> Column:
    return F.sha2(_col(text), 256)


ID_PREFIX = "SLD-"  # fixed value: what stored article ids begin with


def article_id(content, prefix: str = ID_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(_col(content), 256), 1, 8)))


def cache_key(text, model, prompt, options) -> Column:
    """options: the sorted JSON of the inference options."""
    return F.sha2(F.concat_ws("||", _col(text), _col(model), _col(prompt), _col(options)), 256)


def preview(text, n: int = 140) -> Column:
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def page_range(first, last) -> Column:
    a, b = _col(first), _col(last)
    return F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))


def size_text(n) -> Column:
    """Bytes in B, KB, MB or GB."""
    x = _col(n).cast("double")
    k = 1024.0
    return (
        F.when(x < k, F.format_string("%.0f B", x)).when(x < k**2, F.format_string("%.1f KB", x / k))
        .when(x < k**3, F.format_string("%.1f MB", x / k**2)).otherwise(F.format_string("%.2f GB", x / k**3))
    )


def duration_text(seconds) -> Column:
    s = F.floor(_col(seconds)).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))
