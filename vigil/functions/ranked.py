"""A sorted multiset that can be asked for its k-th value, its median and its median absolute deviation."""

from __future__ import annotations

from bisect import bisect_left, insort

#: A block is split when it holds twice as many values.
BLOCK = 512


class Ranked:
    """Values in ascending order, in blocks, so that adding, removing and ranking move few of them."""

    __slots__ = ("blocks", "size")

    def __init__(self):
        self.blocks: list[list] = []
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def _block(self, value) -> int:
        """The first block whose last value is not below ``value``; the last block if there is none."""
        low, high = 0, len(self.blocks) - 1
        while low < high:
            mid = (low + high) // 2
            if self.blocks[mid][-1] < value:
                low = mid + 1
            else:
                high = mid
        return low

    def add(self, value) -> None:
        self.size += 1
        if not self.blocks:
            self.blocks.append([value])
            return
        at = self._block(value)
        block = self.blocks[at]
        insort(block, value)
        if len(block) > 2 * BLOCK:
            self.blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]

    def remove(self, value) -> None:
        """Take one occurrence of ``value`` away; it must be there."""
        at = self._block(value)
        block = self.blocks[at]
        place = bisect_left(block, value)
        if place == len(block) or block[place] != value:
            raise KeyError(value)
        del block[place]
        self.size -= 1
        if not block:
            del self.blocks[at]

    def __getitem__(self, k: int):
        """The k-th smallest value, from 0."""
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        raise IndexError(k)

    def first(self):
        """The smallest value; there must be one."""
        return self.blocks[0][0]

    def _values(self):
        """What indexes fastest by rank: the only block, or all of them."""
        return self.blocks[0] if len(self.blocks) == 1 else self

    def below(self, value) -> int:
        """How many values are smaller."""
        if not self.blocks:
            return 0
        at = self._block(value)
        return sum(map(len, self.blocks[:at])) + bisect_left(self.blocks[at], value)

    def median(self) -> float | None:
        """Mean of the two middle values; None when empty."""
        if not self.size:
            return None
        values = self._values()
        return (values[(self.size - 1) // 2] + values[self.size // 2]) / 2

    def spread(self, centre: float) -> float:
        """Median of the distances from ``centre``; 0 when empty.

        Distances grow away from the centre on both sides, so the k-th smallest is found by halving, without listing them.
        """
        if not self.size:
            return 0.0
        values = self._values()
        left = self.below(centre)
        right = self.size - left

        def kth(k: int) -> float:
            low, high = max(0, k + 1 - right), min(left, k + 1)
            while low < high:  # the fewest values of the left side among the k + 1 nearest
                mid = (low + high) // 2
                if abs(values[left - 1 - mid] - centre) < abs(values[left + k - mid] - centre):
                    low = mid + 1
                else:
                    high = mid
            near = [abs(values[left - low] - centre)] if low else []
            near += [abs(values[left + k - low] - centre)] if k + 1 > low else []
            return max(near)

        lower = kth((self.size - 1) // 2)
        upper = lower if self.size % 2 else kth(self.size // 2)
        return (lower + upper) / 2
