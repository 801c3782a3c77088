"""Pages for the paged source, importable by Spark's workers."""

from __future__ import annotations

PAGES = {"u1": ([{"name": "One", "id": "1"}, {"name": "Two", "id": "2"}], "u1-2"), "u1-2": ([{"name": "Three", "id": "3"}], None), "bad": ([{"name": "Four"}], "bad-2"), "none": ([], None)}


def fetch(url: str):
    if url == "bad-2":
        raise OSError("no access")
    if url not in PAGES:
        raise FileNotFoundError(url)
    return PAGES[url]
