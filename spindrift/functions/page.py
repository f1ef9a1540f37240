"""HTML pages as flat lists of events, which the page operators fold over.

An event is ``(kind, name, attributes)``: an opened or closed element, or a text.  What is hidden, nested
or paired is told by separate small folds, so each operator takes only the ones it needs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

from pyspark import cloudpickle

OPEN, CLOSE, TEXT = "open", "close", "text"
# Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
Event = tuple[str, str, dict]


class _Tape(HTMLParser):
    def __init__(self):
        super().__init__()
        self.events: list[Event] = []

    def handle_starttag(self, tag, attrs):
        self.events.append((OPEN, tag, dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.events.append((OPEN, tag, dict(attrs)))
        if tag not in VOID:
            self.events.append((CLOSE, tag, {}))

    def handle_endtag(self, tag):
        self.events.append((CLOSE, tag, {}))

    def handle_data(self, data):
        self.events.append((TEXT, data, {}))


def events(html: str, to_end: bool = True) -> list[Event]:
    """The events of a page; what is unfinished at its end only with ``to_end``."""
    tape = _Tape()
    tape.feed(html)
    if to_end:
        tape.close()
    return tape.events


def opened(tape: Iterable[Event], *tags: str) -> Iterator[tuple[str, dict]]:
    """(tag, attributes) of the elements opened, of the named kinds only."""
    return ((name, attrs) for kind, name, attrs in tape if kind == OPEN and name in tags)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
