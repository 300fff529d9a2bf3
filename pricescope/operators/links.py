"""Addresses of the pages that reports send their readers to."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each page's path (``{}`` is what it is about) and its parameters; those named like ``{view}`` are given by the caller.
PAGES = {
    "dashboard": ("/dashboard", {}),
    "product": ("/products/{}", {}),
    "product_content": ("/products/{}", {"tab": "content"}),
    "products_by_gap": ("/products", {"sort": "gap", "order": "desc"}),
    "products_by_position": ("/products", {"position": "{position}", "sort": "gap", "order": "desc"}),
    "alerts": ("/alerts", {"type": "{type}"}),
    "brand": ("/brands/{}", {}),
    "brands": ("/brands", {}),
    "opportunities": ("/opportunities", {"brand": "{brand}", "view": "{view}"}),
    "content": ("/content", {"band": "{band}"}),
    "campaigns": ("/campaigns", {"type": "{type}"}),
    "matrix": ("/matrix", {"position": "{position}"}),
}
#: Characters that stay as they are in a parameter, though form encoding escapes them.
_PLAIN = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def base_url(address: str | None) -> str | None:
    """An application's address without query, fragment and closing slashes; none unless it is http or https."""
    parts = urlsplit((address or "").strip())
    if parts.scheme.lower() not in ("http", "https") or not parts.netloc:
        return None
    return f"{parts.scheme.lower()}://{parts.netloc.lower()}{re.sub('/+$', '', parts.path)}"


def encoded(value: Column) -> Column:
    """A value as part of an address: a space is %20, never a plus sign."""
    out = F.url_encode(value.cast("string"))
    for escaped, char in _PLAIN.items():
        out = F.replace(out, F.lit(escaped), F.lit(char))
    return out


def page_link(app: str | None, page: str, subject: Column | None = None, **given: Column) -> Column:
    """The address of a page, null without an application's address. Parameters without a value, and empty ones, are left out."""
    path, parameters = PAGES[page]
    base = base_url(app)
    if base is None:
        return F.lit(None).cast("string")
    head, _, tail = path.partition("{}")
    target = F.lit(base + path) if subject is None else F.concat(F.lit(base + head), encoded(subject), F.lit(tail))
    shown = []
    for name, value in parameters.items():
        column = given.get(value[1:-1], F.lit(None).cast("string")) if value.startswith("{") else F.lit(value)
        shown.append(F.when(F.coalesce(column.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}="), encoded(column))))
    query = F.concat_ws("&", *shown)
    return F.concat(target, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
