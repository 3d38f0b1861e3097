"""A bounded memory for what a task computes again and again."""

from __future__ import annotations

from collections.abc import Callable

#: Keys up to this many characters or bytes are remembered; longer ones seldom come again.
LONGEST = 48
#: About what an entry takes besides its characters: the dictionary's place, key and value objects.
EACH = 140


class Memo(dict):
    """make(key), remembered for short keys within about `most` bytes.

    When half of that is full, it becomes the older generation and the one before
    is forgotten, so what is asked for often stays. Most live as long as the iterator
    of a partition; that of op7 as long as its worker.
    """

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make = make
        self.room = most // 2
        self.used = 0
        self.older: dict = {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONGEST:
            if self.used > self.room:
                self.older = dict(self)
                self.clear()
                self.used = 0
            self.used += EACH + len(key) + (len(got) if isinstance(got, bytes) else 0)
            self[key] = got
        return got
