"""What a worker remembers between batches."""

from __future__ import annotations


class Remembered:
    """A memory of two generations: what was asked for since the last change survives the next."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def turn(self) -> dict:
        """What is young now, after a change of generations if it holds too much; once for a batch, or what was found is lost."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        return self.young

    def missing(self, keys: set, turn: bool = True) -> list:
        """Those of ``keys`` that are not known.  The others, and what is then added, can be read from ``young``.

        Only the first call for a batch may ``turn`` to a new generation: what an earlier call found must stay readable.
        """
        if turn:
            self.turn()
        absent = []
        for key in keys.difference(self.young):
            if key in self.old:
                self.young[key] = self.old[key]
            else:
                absent.append(key)
        return absent
