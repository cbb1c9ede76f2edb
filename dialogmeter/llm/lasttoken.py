"""Byte-pair encoding by last tokens.

A sequence of tokens is the encoding of its text exactly when each pair of neighbours is the
encoding of that pair's own text: merges run in one fixed order, so the first merge across a
boundary would also happen with only its two tokens present. The encoding of a prefix therefore
ends in exactly one token, and is the encoding of the shorter prefix plus that token.
"""

from __future__ import annotations

from collections.abc import Callable

NEVER = 1 << 62


class PairRules:
    """Which tokens may stand side by side, for a vocabulary with merge priorities.

    ``rank(a, b)`` is the priority of merging the symbols ``a`` and ``b`` (smaller first), or
    None; ``symbols(token)`` are the symbols a token starts as.
    """

    #: Pairs remembered per worker, in two halves: when the newer one is full, the older one goes.
    MEMO = 600_000

    def __init__(self, rank: Callable[[str, str], int | None], symbols: Callable[[str], list[str]]):
        self.rank, self.symbols = rank, symbols
        self._memo: dict[tuple[str, str], bool] = {}
        self._older: dict[tuple[str, str], bool] = {}
        self._made: dict[str, tuple[int, str, str] | None] = {}

    def merges(self, parts: list[str]) -> tuple[list[str], list[tuple[int, str, str]]]:
        """(tokens, merges in order) of a few symbols, merged step by step."""
        parts, done = list(parts), []
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            done.append((best, parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, done

    def made(self, token: str) -> tuple[int, str, str] | None:
        """(priority, left part, right part) of a token's last merge, with priority -1 for one symbol.

        None for a token that its own symbols don't merge to, or whose merges don't run from
        small to large priority; such tokens are tested by merging.
        """
        if token not in self._made:
            tokens, done = self.merges(self.symbols(token))
            ordered = all(a[0] < b[0] for a, b in zip(done, done[1:], strict=False))
            self._made[token] = None if tokens != [token] or not ordered else done[-1] if done else (-1, "", "")
        return self._made[token]

    def reachable(self, token: str) -> bool:
        """Whether merging the token's own symbols gives the token back."""
        return self.made(token) is not None or self.merges(self.symbols(token))[0] == [token]

    def fits(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right`` are the encoding of their joined text."""
        known = self._memo.get((left, right))
        if known is None:
            if len(self._memo) >= self.MEMO // 2:
                self._older, self._memo = self._memo, {}
            known = self._older.get((left, right))
            if known is None:
                known = self._fits(left, right)
            self._memo[left, right] = known
        return known

    def _fits(self, left: str, right: str) -> bool:
        # Undo the merges beside the boundary, latest first, and see whether a merge across it would have come before.
        a, b, limit = left, right, NEVER
        while True:
            across = self.rank(a, b)
            if across is not None and across < limit:
                return False
            made_a, made_b = self.made(a), self.made(b)
            if made_a is None or made_b is None:
                return self.merges(self.symbols(left) + self.symbols(right))[0] == [left, right]
            if made_a[0] > made_b[0]:
                limit, a = made_a[0], made_a[2]
            elif made_b[0] >= 0:
                # Of two equal merges the left one comes first, here the one across.
                limit, b = made_b[0] + 1, made_b[1]
            else:
                return True
