"""Column expressions. Everything here returns a ``Column`` and runs inside whole-stage codegen
(built-in string, regex and higher-order functions only; no Python UDFs)."""

from career_index.functions.text import (  # noqa: F401
    clean_cell, collapse_ws, contains_folded, fold, name_key, ustrip,
)
from career_index.functions.urls import (  # noqa: F401
    apply_url, canonical_origin, domain_key, ensure_scheme, final_url, netloc, normalize_url,
    page_url, resolve_url, url_path,
)
