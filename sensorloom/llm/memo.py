"""A memory of results, bounded in bytes, in two generations."""

from __future__ import annotations

from collections.abc import Callable


#: Parts of more characters are rare and never kept: so a generation's entries bound its bytes too.
LONGEST = 64


class Memo:
    """Results by part of a text. When the young generation is full it becomes the old one, whose entries
    come back as they are met; so what is common stays known, and at most two generations are held. Parts
    over ``LONGEST`` characters are learned anew each time."""

    def __init__(self, learn: Callable[[set[str]], dict[str, bytes]], generation: int):
        self.learn, self.generation = learn, generation
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def join(self, parts: list[str]) -> bytes:
        """The results of ``parts``, one after the other."""
        young = self.young
        missing = {p for p in parts if p not in young}
        if not missing:
            return b"".join(map(young.__getitem__, parts))
        if long := {p for p in missing if len(p) > LONGEST}:
            missing -= long
        if len(young) + len(missing) > self.generation:
            self.old, self.young = young, {}
            young, missing = self.young, set(parts) - long
        old = self.old
        young.update((p, old[p]) for p in missing if p in old)
        if new := {p for p in missing if p not in old}:
            young.update(self.learn(new))
        if not long:
            return b"".join(map(young.__getitem__, parts))
        once = self.learn(long)
        return b"".join(young[p] if p in young else once[p] for p in parts)
