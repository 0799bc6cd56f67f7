"""Text functions as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that neither queries nor documents are searched by.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "shall", "should", "may", "might", "can", "could", "not", "no", "nor",
    "if", "then", "than", "that", "this", "these", "those", "it", "its",
    "as", "so", "up", "out", "about", "into", "over", "after", "before",
    "between", "under", "above", "below", "through", "during", "each",
    "all", "any", "both", "few", "more", "most", "other", "some", "such",
    "only", "own", "same", "too", "very", "just", "also", "which", "who",
    "whom", "what", "when", "where", "how", "here", "there", "their",
    "them", "they", "we", "us", "our", "you", "your", "he", "she", "his",
    "her", "my", "me",
    "state", "bank", "pakistan",
    "dear", "sir", "madam", "ref", "subject", "please", "kindly",
    "enclosed", "attached", "herewith", "mentioned", "undersigned",
    "regards", "sincerely", "obedient", "servant",
)

# Fixed value: a dot after a single letter, as in "u.s.", is no end of a word.
DOTTED_LETTER = r"(?<=\b[a-z])\.(?=[a-z]|\s|$)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of word characters, Unicode-aware, as they stand."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokens(text: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Lower-case words of two characters or more that are no stopwords; "u.s." is one word."""
    plain = F.regexp_replace(F.lower(text), DOTTED_LETTER, "")
    # A long list of literals is looked up in a hash set.
    return F.filter(words(plain), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))


def blank_split(text: Column) -> Column:
    """Parts between runs of any white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def canonical_words(text: Column) -> Column:
    """Lower-case letters and digits, joined by single blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)), " ")


def collapse(text: Column) -> Column:
    """White space made single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def padded_numbers(tokens_: Column) -> Column:
    """Each token, and for whole numbers also the forms without and with a leading zero."""
    bare = lambda t: F.when(F.ltrim(t, F.lit("0")) == "", "0").otherwise(F.ltrim(t, F.lit("0")))
    forms = lambda t: F.when(t.rlike("^[0-9]+$"), F.array_distinct(F.array(t, bare(t), F.when(F.length(bare(t)) < 2, F.lpad(bare(t), 2, "0")).otherwise(bare(t))))).otherwise(F.array(t))
    return F.flatten(F.transform(tokens_, forms))


def clip(text: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def token_estimate(text: Column, up: bool = True) -> Column:
    """A quarter of the characters, at least one, rounded up or down."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + (3 if up else 0)) / 4)).cast("long")


def places(text: Column, word: str) -> Column:
    """Where a word occurs, counted from 1, as an array; occurrences that overlap count each."""
    length = len(word)
    # The text is cut before every occurrence.
    pieces = F.split(text, f"(?={_quoted(word)})")
    ends = F.transform(pieces, lambda p: F.length(p))
    starts = F.transform(F.sequence(F.lit(1), F.size(ends)), lambda i: F.aggregate(F.slice(ends, F.lit(1), i - 1), F.lit(0), lambda s, x: s + x) + 1)
    return F.transform(F.filter(starts, lambda at: F.substring(text, at, F.lit(length)) == word), lambda at: at.cast("long"))


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)


def excerpt(text: Column, terms: Iterable[str], width: int) -> Column:
    """``width`` characters around the earliest term; the start where none occurs."""
    found = [F.when(F.instr(F.lower(text), t) > 0, F.instr(F.lower(text), t)) for t in terms]
    first = F.coalesce(F.least(*found) if len(found) > 1 else found[0], F.lit(1))
    start = F.greatest(F.lit(1), first - width // 2)
    return F.substring(text, start, F.lit(width))


def excerpt_within(text: Column, terms: Iterable[str], width: Column) -> Column:
    """``excerpt`` of a width that is a column."""
    places = F.filter(F.array(*[F.instr(F.lower(text), t) for t in terms]), lambda p: p > 0)
    start = F.greatest(F.lit(1), F.coalesce(F.array_min(places), F.lit(1)) - F.floor(width / 2).cast("int"))
    return F.substring(text, start, width.cast("int"))


def highlight(text: Column, terms: Iterable[str]) -> Column:
    """Words that begin with a term between mark tags, terms in the order given."""
    for term in terms:
        text = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({term}[\p{{L}}\p{{N}}_]*)", "<mark>$1</mark>")
    return text


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 where both are empty."""
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / all_)


def chunk_count(n: Column, width: int, overlap: int) -> Column:
    """How many overlapping chunks ``n`` words make."""
    step = width - overlap
    return F.when(n <= 0, 0).when(n <= width, 1).otherwise(F.ceil((n - width) / step) + 1).cast("long")


def chunks(words_: Column, width: int, overlap: int) -> Column:
    """The chunks of a word array: starts every ``width - overlap`` words, none after one that reaches the end."""
    step = width - overlap
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(chunk_count(F.size(words_), width, overlap) - 1, F.lit(0).cast("long")))
    return F.when(F.size(words_) > 0, F.transform(starts, lambda i: F.slice(words_, (i * step + 1).cast("int"), width))).otherwise(F.array().cast("array<array<string>>"))


def url_canonical(url: Column) -> Column:
    """Lower case, https, no query, fragment or closing punctuation."""
    plain = F.regexp_replace(F.lower(F.trim(url)), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^http://", "https://"), r"[/.,;:)]+$", "")


def slug(text: Column, width: int = 56) -> Column:
    """Letters and digits joined by hyphens, cut to ``width`` characters."""
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(width)), r"-+$", "")
