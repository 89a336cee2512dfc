"""A plain-Python fabric and compaction, for comparison with the operators."""

from __future__ import annotations

import random
from dataclasses import dataclass, field


@dataclass
class Model:
    parents: dict[int, int] = field(default_factory=lambda: {0: 0})
    tips: dict[str, int] = field(default_factory=lambda: {"DEFAULT": 0})
    locked: set[int] = field(default_factory=set)
    base: dict[int, str] = field(default_factory=dict)
    adds: dict[tuple[int, int], str] = field(default_factory=dict)
    deletes: list[tuple[int, int, int]] = field(default_factory=list)

    def walk(self, tip: int) -> set[int]:
        found = set()
        while tip:
            found.add(tip)
            tip = self.parents[tip]
        return found

    def visible(self, tip: int) -> dict[int, str]:
        lineage, seen = self.walk(tip), {}
        objects = {o for o, _ in self.adds} | set(self.base)
        for o in objects:
            states = [s for a, s in self.adds if a == o and s in lineage]
            if states:
                top = max(states)
                if not any(d == o and s in lineage and s > top for d, s, _ in self.deletes):
                    seen[o] = self.adds[o, top]
            elif o in self.base and not any(d == o and at in lineage for d, _, at in self.deletes):
                seen[o] = self.base[o]
        return seen

    def collapse_pairwise(self) -> None:
        """Folds one state at a time into its parent, from the lowest up, as long as any can go."""
        fixed = {0, *self.tips.values(), *self.locked}
        for child in sorted(self.parents):
            parent = self.parents[child]
            if child in fixed or parent in fixed:
                continue
            if sum(p == parent for s, p in self.parents.items() if s) != 1 or sum(p == child for s, p in self.parents.items() if s) >= 2:
                continue
            touched = {o for o, s in self.adds if s == child} | {d for d, s, _ in self.deletes if s == child}
            self.adds = {(o, s): v for (o, s), v in self.adds.items() if not (s == parent and o in touched)}
            self.deletes = [(d, s, at) for d, s, at in self.deletes if not (s == parent and d in touched)]
            self.adds = {(o, parent if s == child else s): v for (o, s), v in self.adds.items()}
            self.deletes = [(d, parent if s == child else s, parent if at == child else at) for d, s, at in self.deletes]
            self.parents = {s: parent if p == child else p for s, p in self.parents.items() if s != child}


def random_model(seed: int, steps: int = 18) -> Model:
    """Versions are made, edited, left and merged at random."""
    rng, m = random.Random(seed), Model()
    m.base = {o: f"base{o}" for o in range(1, 6)}
    for step in range(steps):
        name = rng.choice(sorted(m.tips))
        what = rng.random()
        if what < 0.25 and len(m.tips) < 5:
            m.tips[f"V{step}"] = m.tips[name]
        elif what < 0.75:
            state = max(m.parents) + 1
            m.parents[state] = m.tips[name]
            seen = m.visible(m.tips[name])
            m.tips[name] = state
            kind, o = rng.random(), rng.choice(sorted(seen) or [1])
            if kind < 0.5 or not seen:
                m.adds[100 + step, state] = f"new{step}"
            elif kind < 0.8:
                m.adds[o, state] = f"update{step}"
                if rng.random() < 0.5:
                    m.deletes.append((o, state, state))
            else:
                # Markers of the root state are for base rows that no add of the lineage has replaced.
                plain = o in m.base and not any(a == o and s in m.walk(state) for a, s in m.adds)
                m.deletes.append((o, rng.choice([state, 0]) if plain else state, state))
        elif what < 0.88 and name != "DEFAULT":
            del m.tips[name]
        elif name != "DEFAULT" and m.tips["DEFAULT"] in m.walk(m.tips[name]) | {0}:
            m.tips["DEFAULT"] = m.tips[name]
    if rng.random() < 0.3:
        m.locked = {rng.choice(sorted(m.parents))} - {0}
    return m
