"""Text expressions: tokens, HTML stripping, keys.

All of these are built-in Spark SQL expressions, so they stay inside
whole-stage code generation and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------
# Token = maximal run of Unicode letters and digits, after lower-casing.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# HTML to text: each pattern is replaced by one space, case-insensitive and
# with '.' matching newlines; then whitespace runs collapse to one space.
HTML_DROP_PATTERNS = (
    r"(?is)<!--.*?-->",
    r"(?is)<(script|style)[^>]*>.*?</(script|style)>",
    r"(?is)<[^>]+>",
)
# A short fixed list of character entities, decoded after tags are gone;
# '&amp;' goes last so that '&amp;lt;' becomes '&lt;', not '<'.
HTML_ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
)
WHITESPACE_RUN = r"[ \t\r\n]+"
# ------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """array<string> of lower-cased letter/digit runs; null text gives null."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), 0)


# A table may carry its precomputed tokens under this name (for example a
# chunk index written once); operators then read it instead of tokenizing.
TOKENS_COL = "text_tokens"


def tokens_of(df, text) -> Column:
    """The tokens of ``text`` in ``df``: the stored ``text_tokens`` column when
    the table has one, else ``tokens(text)``."""
    return F.col(TOKENS_COL) if TOKENS_COL in df.columns else tokens(text)


def html_to_text(html) -> Column:
    """Visible text of an HTML page (comments, scripts, styles and tags removed)."""
    out = _col(html)
    for pattern in HTML_DROP_PATTERNS:
        out = F.regexp_replace(out, pattern, " ")
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, WHITESPACE_RUN, " "))


def chunk_key(text) -> Column:
    """Index key of a chunk: md5 of its text (equal texts share a key)."""
    return F.md5(_col(text))


def user_key(address) -> Column:
    """Short user key from an e-mail address: the part before '@', dots removed,
    lower case, at most 35 characters."""
    local = F.substring_index(_col(address), "@", 1)
    return F.substring(F.lower(F.replace(local, F.lit("."), F.lit(""))), 1, 35)


def current_user_key() -> Column:
    """The session user's key (``current_user()`` through ``user_key``), used
    to name per-user catalogs, schemas and endpoints."""
    return user_key(F.current_user())
