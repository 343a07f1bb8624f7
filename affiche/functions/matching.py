"""Word lists as one regular expression each.

A list becomes a prefix tree written as a pattern. In front of it stand character
classes, one per position: what may come first, second, third and so on. They are
plain table look-ups and turn most text positions away before any branch of the
tree is tried. Measured on 15 MB of text and one core: 0.8 s for 29 words and 4.4 s
for 117, against 1.8 s and 6.4 s for the tree alone; a flat alternation and a chain
of ``contains`` took seven and three times as long as the tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column


def _tree(words: Iterable[str]) -> str:
    by_head: dict[str, list[str]] = {}
    for word in words:
        if not word:
            return ""  # a word ends here: whatever follows is no longer needed
        by_head.setdefault(word[0], []).append(word[1:])
    arms = [re.escape(head) + _tree(tails) for head, tails in by_head.items()]
    return arms[0] if len(arms) == 1 else "(?:" + "|".join(arms) + ")"


def _pattern(needed: list[str]) -> str:
    positions = zip(*needed)  # as many as the shortest word has characters
    classes = ["[" + "".join(sorted(map(re.escape, set(chars)))) + "]" for chars in positions]
    return f"(?={''.join(classes)}){_tree(needed)}"


def any_of(words: Iterable[str]) -> str:
    """Pattern that finds any of the words as a substring."""
    words = sorted(set(words))
    # A word that contains another one can add no hit.
    return _pattern([w for w in words if not any(other != w and other in w for other in words)])


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return text.rlike(any_of(words))


def starts_with_any(text: Column, words: Iterable[str]) -> Column:
    words = sorted(set(words))
    # Here only a word that begins with another one can add no hit.
    return text.rlike("^" + _pattern([w for w in words if not any(other != w and w.startswith(other) for other in words)]))
