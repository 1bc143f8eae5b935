"""Column expressions built only from ``pyspark.sql.functions`` (JVM-side)."""

from docloom.functions.text import (  # noqa: F401
    TOKEN_PATTERN,
    chunk_key,
    current_user_key,
    html_to_text,
    tokens,
    user_key,
)
from docloom.functions.templates import fill_template  # noqa: F401
