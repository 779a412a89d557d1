"""Column expressions over text, urls and chat content. No Python runs for any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search, and the patterns of personal data with what replaces them, in their order.
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "are", "was", "were", "you", "your", "not", "but", "have", "has")
PERSONAL = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[ip]"),
    (r"\b\d{16,19}\b", "[card]"),
    (r"\+?\d[\d -]{8,14}\d", "[phone]"),
)
TODO = r"(?i)\b(?:todo|fixme|remember to|need to)\b[: ]+([^\n.]{3,80})"


def trimmed_url(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "/+$", "")


def host(url: Column) -> Column:
    """Lower-case host without scheme, port, path or query."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)", 1))


def suffixes(name: Column) -> Column:
    """a.b.c as [a.b.c, b.c, c]: turns a domain-suffix match into an equi join."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def merged_domain(name: Column, known: str) -> Column:
    """Whether a host is ``known`` with lost punctuation behind it (``site.orgpage``)."""
    return (name != known) & (F.startswith(name, F.lit(known)) & ~F.startswith(name, F.lit(known + "."))) | F.endswith(name, F.lit("." + known))


def keywords(text: Column, least: int = 2) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))


def redacted(text: Column) -> Column:
    for pattern, placeholder in PERSONAL:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def once(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_lines(text: Column, least: int = 2) -> Column:
    """Recognised text without odd characters, short lines and repeated lines (any case)."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\n .,;:!?'()/-]", ""), r"[ ]+", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    placed = F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x")))
    first = lambda ls: F.filter(ls, lambda s, i: (i == 0) | (s["low"] != F.get(ls, i - 1)["low"]))
    kept = once(F.array_sort(placed), lambda ls: F.array_sort(F.transform(first(ls), lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))))
    return F.array_join(F.transform(kept, lambda s: s["x"]), "\n")


def quality_gate(text: Column, cleaned: Column) -> Column:
    """Whether enough of a recognised text is left after cleaning."""
    return (F.length(cleaned) >= 4) & (F.length(cleaned) / F.greatest(F.length(text), F.lit(1)) >= 0.45)


def html_text(html: Column) -> Column:
    """Visible text: blocks without text dropped, tags as newlines, common references decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?(</\1\s*>|$)", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?(-->|$)", "")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def excerpt(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def pretokens(text: Column) -> Column:
    """Distinct search terms: lower-case runs of ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 0))


def prefixed_digest(*parts: Column) -> Column:
    """SHA-256 over parts, each behind its length in eight bytes: no two lists collide by joining."""
    sized = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p.cast("binary")) for p in parts]
    return F.sha2(F.concat(*sized), 256)
