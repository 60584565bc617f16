"""Globs that reach an area's files and no other area's.

A cover is worked out from one row a directory, in a task for each area: the area's directories as they are, or the largest subtree
with the foreign subtrees taken out, whichever needs fewer globs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple


class Glob(NamedTuple):
    dir: str
    deep: bool
    negated: bool = False

    def text(self, exts: Iterable[str]) -> str:
        names = sorted(exts)
        tail = f"*.{names[0]}" if len(names) == 1 else "*.{" + ",".join(names) + "}"
        return ("!" if self.negated else "") + "/".join(x for x in (self.dir, "**" if self.deep else "", tail) if x)


def _up(path: str, root: str) -> Iterator[str]:
    """A directory and those above it, up to and with `root`."""
    yield path
    while path != root and "/" in path:
        path = path.rpartition("/")[0]
        yield path


def cover(own: set[str], every: set[str], root: str) -> list[Glob]:
    """Globs for the directories `own` at or below `root`, among the directories `every`; a tie goes to globs without
    exceptions. Subtrees are counted once, by the directories above each one."""
    foreign = {d for d in every - own if d == root or d.startswith(f"{root}/")}
    held, strange = (Counter(a for d in of for a in _up(d, root)) for of in (own, foreign))

    def tops(paths: set[str], free: Counter[str]) -> list[str]:
        """The highest directories whose subtree holds none of `free`, so that they cover `paths`."""
        out: set[str] = set()
        for p in sorted(paths):
            above = list(_up(p, root))
            if out.isdisjoint(above[1:]):
                last = p
                for a in above[1:]:
                    if free[a]:
                        break
                    last = a
                out.add(last)
        return sorted(t for t in out if out.isdisjoint(list(_up(t, root))[1:]))

    positive = []
    found = tops(own, strange) if foreign else [root]
    at: dict[str, list[str]] = {t: [t] if t in own else [] for t in found}
    for d in own - set(found):
        at[next(a for a in _up(d, root) if a in at)].append(d)
    for top in found:
        positive += [Glob(d, False) for d in sorted(at[top])] if strange[top] else [Glob(top, True)]
    negative = [Glob(root, True), *[Glob(t, not held[t], True) for t in tops(foreign, held)]]
    shared = any(held[g.dir] and not g.deep for g in negative[1:])
    return positive if shared or len(positive) <= len(negative) else negative


def reaches(globs: Iterable[Glob], path: str) -> bool:
    dir_ = path.rpartition("/")[0]
    hit = lambda g: dir_ == g.dir or (g.deep and (not g.dir or dir_.startswith(f"{g.dir}/")))
    return any(hit(g) for g in globs if not g.negated) and not any(hit(g) for g in globs if g.negated)
