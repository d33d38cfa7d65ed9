"""Blocks of a pair by the standard library's matcher, against which the operator is tested."""

import difflib
from collections.abc import Iterator

from ledgerloom.operators.diff import KEEP


def block_rows(previous: list[str], latest: list[str]) -> Iterator[tuple]:
    """Blocks in order; of an equal run of more than 2 * KEEP + 1 only its ends are shown."""
    matcher = difflib.SequenceMatcher(None, previous, latest, autojunk=False)
    for tag, a0, a1, b0, b1 in matcher.get_opcodes():
        if tag != "equal":
            yield from (("removed", s, None) for s in previous[a0:a1])
            yield from (("added", s, None) for s in latest[b0:b1])
        elif b1 - b0 <= 2 * KEEP + 1:
            yield from (("context", s, None) for s in latest[b0:b1])
        else:
            yield from (("context", s, None) for s in latest[b0 : b0 + KEEP])
            yield "collapsed", None, b1 - b0 - 2 * KEEP
            yield from (("context", s, None) for s in latest[b1 - KEEP : b1])
