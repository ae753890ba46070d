"""A transport for the paged source: two pages of one symbol, a retry in between."""

import json

PAGES = {
    "": {"bars": {"ZA": [{"t": "2026-03-02T14:29:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 5, "n": 1, "vw": 1.5}, {"t": "2026-03-02T05:00:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 5}]}, "next_page_token": "k2"},
    "k2": {"bars": {"ZA": [{"t": "2026-03-02T14:30:00Z", "o": 2, "h": 2, "l": 2, "c": 2, "v": 7}]}, "next_page_token": None},
}


def make():
    failed = []

    def get(url):
        if not failed:
            failed.append(1)
            return 503, {"Retry-After": "0"}, ""
        token = url.partition("page_token=")[2]
        return 200, {}, json.dumps(PAGES[token])

    return get
