"""A plain one-row-at-a-time model of identity resolution, for checking the batch jobs on small input."""

from __future__ import annotations

import uuid
from fractions import Fraction

from fairline.functions.keys import CANONICAL_NAMESPACE
from fairline.functions.text import folded_name, strict_name


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def similarity(a: str, b: str) -> Fraction:
    a, b = strict_name(a), strict_name(b)
    if a == b:
        return Fraction(1)
    if folded_name(a) == folded_name(b):
        return Fraction(98, 100)
    longest = max(len(a), len(b))
    ta, tb = set(a.split()), set(b.split())
    dice = Fraction(2 * len(ta & tb), len(ta) + len(tb)) if ta or tb else Fraction(1)
    return min(max(1 - Fraction(edit_distance(a, b), longest), dice), Fraction(97, 100))


def canonical(book: str, kind: str, source: str) -> str:
    return str(uuid.uuid5(uuid.UUID(CANONICAL_NAMESPACE), f"{book}:{kind}:{source}"))


def verdict(scored, auto, gate, margin, plausible):
    """scored: list of (score, name, id)."""
    ranked = sorted(scored, key=lambda c: (-c[0], c[2]))
    if ranked:
        best = ranked[0]
        gap = best[0] - (ranked[1][0] if len(ranked) > 1 else 0)
        if best[0] >= auto and best[1] >= gate and gap >= margin:
            return "matched", "auto_match", best[2]
        if best[0] >= plausible:
            short = "insufficient_margin" if gap < margin else "plausible_candidate_below_auto_threshold"
            return "ambiguous", short, None
    return "created", "no_plausible_candidate", None


def half(a, b, weight):
    return weight / 2 if a is None or b is None else (weight if a == b else Fraction(0))


class ParticipantStore:
    """Entities, aliases, mappings and decisions, changed after every row."""

    kind = "participant"

    def __init__(self, entities=()):
        self.entities = {e["id"]: dict(e, names={e["name"]}) for e in entities}
        self.mappings: dict = {}
        self.decisions: dict = {}

    def score(self, source, entity):
        s, c = source["meta"], entity["meta"]
        concrete = [k for k in (s[0], c[0]) if k not in (None, "other")]
        if len(concrete) == 2 and concrete[0] != concrete[1]:
            return None
        name = max(similarity(source["name"], n) for n in entity["names"])
        points = Fraction(15, 100) * (1 if len(concrete) == 2 else Fraction(1, 2)) + half(s[1], c[1], Fraction(5, 100))
        return Fraction(80, 100) * name + points, name

    limits = (Fraction(92, 100), Fraction(94, 100), Fraction(8, 100), Fraction(78, 100))

    def resolve(self, source):
        key = (source["book"], source["id"])
        if key in self.mappings:
            return "reused", "mapping_reused", self.mappings[key]
        fingerprint = (*key, source["sport"], strict_name(source["name"]), source["meta"])
        if fingerprint in self.decisions:
            return self.decisions[fingerprint]
        if not strict_name(source["name"]):
            result = ("rejected", "invalid_name", None)
        else:
            scored = []
            for entity in self.entities.values():
                if entity["sport"] == source["sport"]:
                    value = self.score(source, entity)
                    if value is not None:
                        scored.append((value[0], value[1], entity["id"]))
            result = verdict(scored, *self.limits)
            if result[0] == "created":
                made = canonical(source["book"], self.kind, source["id"])
                result = (result[0], result[1], made)
                self.entities[made] = {"id": made, "sport": source["sport"], "meta": source["meta"], "names": {source["name"]}}
        self.decisions[fingerprint] = result
        if result[2]:
            self.mappings[key] = result[2]
            self.entities[result[2]]["names"].add(source["name"])
        return result


class CompetitionStore(ParticipantStore):
    kind = "competition"
    limits = (Fraction(92, 100), Fraction(90, 100), Fraction(8, 100), Fraction(75, 100))

    def score(self, source, entity):
        s, c = source["meta"], entity["meta"]
        if any(a is not None and b is not None and a != b for a, b in zip(s, c, strict=True)):
            return None
        name = max(similarity(source["name"], n) for n in entity["names"])
        weights = (Fraction(15, 100), Fraction(10, 100), Fraction(5, 100))
        return Fraction(70, 100) * name + sum(half(a, b, w) for a, b, w in zip(s, c, weights, strict=True)), name


class EventStore:
    """Events of one sport each; parents are given as canonical ids."""

    def __init__(self, entities=()):
        self.entities = {e["id"]: e for e in entities}
        self.mappings: dict = {}
        self.decisions: dict = {}

    @staticmethod
    def _map(event, field):
        values = [p[field] for p in event["people"]]
        if any(v is None for v in values) or len(set(values)) != len(values):
            return None
        return {p[field]: p["id"] for p in event["people"]}

    def resolve(self, source):
        key = (source["book"], source["id"])
        if key in self.mappings:
            return "reused", "mapping_reused", self.mappings[key]
        state = self._decide(source)
        fingerprint = (*key, str(sorted((k, str(v)) for k, v in source.items())))
        if fingerprint in self.decisions:
            return self.decisions[fingerprint]
        if state[0] == "created":
            made = canonical(source["book"], "event", source["id"])
            self.entities[made] = dict(source, id=made)
            state = (state[0], state[1], made)
        self.decisions[fingerprint] = state
        if state[2]:
            self.mappings[key] = state[2]
        return state

    def _decide(self, source):
        if source["live"]:
            return "rejected", "out_of_scope_live", None
        auto, guard = (6 * 3600, 48 * 3600) if source["sport_code"] == "tennis" else (1800, 86400)
        people = sorted(p["id"] for p in source["people"])
        scored, risks = [], set()
        for entity in self.entities.values():
            if entity["sport"] != source["sport"] or sorted(p["id"] for p in entity["people"]) != people:
                continue
            both = source["comp"] is not None and entity["comp"] is not None
            if both and source["comp"] != entity["comp"]:
                continue
            delta = abs(source["start"] - entity["start"])
            if delta > guard:
                continue
            roles = (self._map(source, "role"), self._map(entity, "role"))
            spots = (self._map(source, "position"), self._map(entity, "position"))
            comparable = None not in roles
            placed = not comparable and None not in spots
            if comparable and roles[0] != roles[1]:
                risks.add(0)
            elif placed and spots[0] != spots[1]:
                risks.add(1)
            elif delta > auto:
                risks.add(2)
            else:
                name = Fraction(1, 2)
                if source["name"] is not None and entity["name"] is not None:
                    name = similarity(source["name"], entity["name"])
                score = (
                    Fraction(50, 100)
                    + Fraction(10, 100) * (1 if comparable or placed else Fraction(1, 2))
                    + Fraction(25, 100) * (1 - Fraction(1, 2) * Fraction(delta, auto))
                    + Fraction(10, 100) * (1 if both else Fraction(1, 2))
                    + Fraction(5, 100) * name
                )
                scored.append((score, Fraction(1), entity["id"]))
        state = verdict(scored, Fraction(90, 100), 0, Fraction(5, 100), Fraction(78, 100))
        if state[0] == "created" and risks:
            reasons = ("duplicate_risk_role_conflict", "duplicate_risk_position_conflict", "duplicate_risk_time_window")
            return "ambiguous", reasons[min(risks)], None
        return state
