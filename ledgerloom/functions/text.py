"""Scalar text functions: normalising, tokens, hashes, quality, slots read from questions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import let

# Characters that are not seen, entities left by markup, the replacement character.
INVISIBLE = "[​‌‍﻿­⁠]"
ENTITY = r"&(?:cr|nbsp|amp|lt|gt|quot|#\d+);"
REPLACEMENT = "�"

RUN = r"[가-힣]+|[a-z0-9][a-z0-9._\-/]*"
UNSAFE = r"[^0-9A-Za-z가-힣]"


def _form(name: str):
    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(name, x))

    return form


def unicode_form(text: Column, name: str = "NFKC") -> Column:
    """A Unicode normal form. Spark has none; ASCII texts skip the Arrow transfer's work, not
    the transfer, so ask for this only where texts are not known to be normal."""
    return _form(name)(text)


def tidy(text: Column) -> Column:
    """Everything of `normalize` but the Unicode form: native."""
    for pattern, to in ((INVISIBLE, ""), (ENTITY, " "), (REPLACEMENT + "+", " "), ("[ \t ]+", " "), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize(text: Column, nfkc: bool = True) -> Column:
    return tidy(unicode_form(text) if nfkc else text)


def _seen(text: Column) -> Column:
    """What `tidy` does as far as tokens can tell: white space and the replacement character part
    tokens anyway, and most texts hold nothing invisible and no entity."""
    clean = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), ENTITY, " ")
    return F.when(text.rlike(f"{INVISIBLE}|&[a-z#]"), clean).otherwise(text)


def tokens(text: Column, ngram: bool = True, keep_word: bool = False, nfkc: bool = False) -> Column:
    """Words and identifiers in order. Hangul runs become character pairs (and the run itself with
    keep_word, if longer than a pair); identifiers stay whole and are also split at . _ - /"""

    def pairs(r: Column) -> Column:
        if not ngram:
            return F.array(r)
        n = F.length(r)
        two = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(r, i, F.lit(2)))
        out = F.when(n < 2, F.array(r)).otherwise(two)
        return F.when(n > 2, F.concat(two, F.array(r))).otherwise(out) if keep_word else out

    def parts(r: Column) -> Column:
        cut = F.concat(F.array(r), F.filter(F.split(r, r"[._\-/]+"), lambda p: (p != "") & (p != r)))
        return F.when(r.rlike(r"[._\-/]"), cut).otherwise(F.array(r))

    text = unicode_form(text) if nfkc else text
    runs = F.regexp_extract_all(F.lower(_seen(text)), F.lit(RUN), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[가-힣]"), pairs(r)).otherwise(parts(r))))


def index_tokens(text: Column, **how) -> Column:
    """Tokens as the index stores them: marks removed, '_' for one of marks alone."""
    return F.transform(
        tokens(text, **how),
        lambda t: F.when(
            t.rlike(r"[._\-/]"), F.coalesce(F.nullif(F.regexp_replace(t, UNSAFE, ""), F.lit("")), F.lit("_"))
        ).otherwise(t),
    )


_RUNS, _PARTS = re.compile(RUN), re.compile(r"[._\-/]+")
_UNSEEN, _INVISIBLE, _ENTITY = re.compile(f"{INVISIBLE}|&[a-z#]"), re.compile(INVISIBLE), re.compile(ENTITY, re.A)


def token_counts(text: str, nfkc: bool = False) -> Counter:
    """`index_tokens` of one text with their counts, for Python that works on batches: a higher-order function walks a
    text some forty times slower."""
    if nfkc and not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if _UNSEEN.search(text):
        text = _ENTITY.sub(" ", _INVISIBLE.sub("", text))
    out = Counter(_RUNS.findall(text.lower()))
    for run, n in [x for x in out.items() if not (x[0].isascii() and x[0].isalnum())]:
        if not run.isascii():
            if len(run) <= 2:
                continue
            parts = [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            parts = [_PARTS.sub("", run), *[p for p in _PARTS.split(run) if p and p != run]]
        del out[run]
        for p in parts:
            out[p] += n
    return out


def query_terms(text: Column, **how) -> Column:
    """Distinct tokens of a question, sorted."""
    t = F.transform(tokens(text, **how), lambda t: F.regexp_replace(t, UNSAFE, ""))
    return F.array_sort(F.array_distinct(F.filter(t, lambda x: x != "")))


def coverage(question: Column, texts: Column) -> Column:
    """Share of the question's tokens of two or more characters that texts hold; 0 with none."""

    def long(x: Column) -> Column:
        return F.array_distinct(F.filter(x, lambda t: F.length(t) >= 2))

    q = long(tokens(question))
    return let(q, lambda q: F.coalesce(F.try_divide(F.size(F.array_intersect(q, long(tokens(texts)))), F.size(q)), F.lit(0.0)))


# hashes and ids


def content_hash(text: Column, nfc: bool = True) -> Column:
    t = unicode_form(text, "NFC") if nfc else text
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.sha2(t.cast("binary"), 256)


def stable_id(source_type: Column, source_name: Column, own_id: Column, url: Column) -> Column:
    key = F.coalesce(F.nullif(own_id, F.lit("")), url)
    return F.substring(F.sha2(F.concat_ws("|", source_type, source_name, key).cast("binary"), 256), 1, 16)


def fingerprint(raw: Column, signature: Column) -> Column:
    return F.substring(F.sha2(F.concat(signature, F.lit("\0"), raw).cast("binary"), 256), 1, 32)


# quality


def readable_ratio(text: Column) -> Column:
    n = F.length(text)
    bad = n - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))
    return F.when(n > 0, F.round(1 - bad / n, 4)).otherwise(F.lit(1.0))


def is_corrupt(ratio: Column) -> Column:
    return F.coalesce(ratio < F.lit(0.95), F.lit(False))


def original_chars(text: Column) -> Column:
    """Length before truncation, from the marker at the end; null where there is none."""
    n = F.regexp_extract(text, r"\[\.\.\.이하 생략, 원문 총 ([\d,]+)자 중 [\d,]+자까지만 캡처됨", 1)
    return F.regexp_replace(n, ",", "").try_cast("bigint")


# slots of a question


def year_slot(text: Column) -> Column:
    """A year only with a cue: 2003년, FY2024, 2024 Q1, 2024 3분기."""
    y = r"(19[89]\d|20[0-4]\d)"
    found = [
        F.regexp_extract(text, rf"(?i){y}\s*년", 1),
        F.regexp_extract(text, rf"(?i)FY\s?{y}", 1),
        F.regexp_extract(text, rf"(?i){y}\s*(?:Q[1-4]|[1-4]\s*분기)", 1),
    ]
    # the first in the text counts, as one alternation finds it
    any_ = F.regexp_extract(text, rf"(?i)(?:{y}\s*년|FY\s?{y}|{y}\s*(?:Q[1-4]|[1-4]\s*분기))", 0)
    digits = F.regexp_extract(any_, r"(?:19[89]\d|20[0-4]\d)", 0)
    return F.when(F.coalesce(*[F.nullif(f, F.lit("")) for f in found]).isNotNull(), digits)


# Words that tell the kind of document a question is about, in order.
TYPE_HINTS = (
    (r"공시|보고서|사업보고서|분기보고서|반기보고서|접수번호", ("DartFiling", "SecFiling")),
    (r"13F|보유\s*현황|포트폴리오\s*(비중|편입)", ("HoldingsSnapshot",)),
    (r"리포트|리서치|목표주가|투자의견", ("ResearchNote", "MarketCommentary")),
)
NUMERIC_WORDS = ("총", "합계", "몇", "규모", "얼마", "개수", "비중", "집중도")


def type_slot(text: Column) -> Column:
    out = None
    for pattern, types in TYPE_HINTS:
        cond, got = text.rlike(pattern), F.array(*[F.lit(t) for t in types])
        out = F.when(cond, got) if out is None else out.when(cond, got)
    return out.otherwise(F.array().cast("array<string>"))


def wants_number(text: Column) -> Column:
    return text.rlike("|".join(NUMERIC_WORDS))


def quarter_slot(text: Column) -> Column:
    """'YYYY-Qn' from a quarter, or from a month end."""
    y, q = (F.regexp_extract(text, r"(20\d\d)\s*-?\s*Q([1-4])", i) for i in (1, 2))
    my, mm = (F.regexp_extract(text, r"(20\d\d)[년.\-/\s]+(0?[1-9]|1[0-2])(?:월|[.\-/])", i) for i in (1, 2))
    by_month = F.concat(my, F.lit("-Q"), (F.floor((mm.try_cast("int") - 1) / 3) + 1).cast("string"))
    return F.when(y != "", F.concat(y, F.lit("-Q"), q)).when(my != "", by_month)


def fiscal_quarter(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def number(text: Column) -> Column:
    """The number in a table cell: all but digits, point and minus removed; null if nothing is left."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.lower(text), r"[^0-9a-z가-힣]+", "-")
    return F.regexp_replace(s, r"^-+|-+$", "")


def safe_path(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def wrap_untrusted(text: Column, mark: str = "UNTRUSTED") -> Column:
    """Text between markers; markers inside it are broken first."""
    inner = F.regexp_replace(text, rf"(?i)<(/?)\s*{mark}", rf"&lt;$1{mark}")
    return F.concat(F.lit(f"<{mark}>\n"), inner, F.lit(f"\n</{mark}>"))


def symbol_candidates(symbol: Column) -> Column:
    """Market prefixes go; six digits may trade on either of two boards."""
    s = F.regexp_replace(symbol, "^(kr|us)-", "")
    return F.when(s.rlike(r"^\d{6}$"), F.array(F.concat(s, F.lit(".KS")), F.concat(s, F.lit(".KQ")))).otherwise(F.array(s))


def filing_kind(name: Column) -> Column:
    """annual, half or quarter by a report's name or form."""
    return (
        F.when(name.contains("사업보고서") | name.rlike(r"(?i)^(10-K|20-F|40-F)"), "annual")
        .when(name.contains("반기보고서"), "half")
        .when(name.contains("분기보고서") | name.rlike(r"(?i)^10-Q"), "quarter")
    )


def strip_markup(html: Column) -> Column:
    """Text of markup: scripts and styles go, block tags break lines, common entities are decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<\s*(br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t ]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def article_urls(text: Column, limit: int = 3, deny: tuple[str, ...] = ()) -> Column:
    """The first few distinct links, trailing marks removed, denied hosts left out."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"')]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    host = lambda u: F.regexp_extract(u, r"^https?://([^/:]+)", 1)
    kept = F.filter(urls, lambda u: ~F.lower(host(u)).rlike("(^|\\.)(" + "|".join(d.replace(".", r"\.") for d in deny) + ")$")) if deny else urls
    return F.slice(F.array_distinct(kept), 1, limit)
