"""Review actions that turn one version of a recording into another."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.intervals import periods_and_gaps
from tessera.operators.ordered import apply_groups
from tessera.operators.review import Session
from tessera.operators.spans import last_before

#: Segments that share no more than this (seconds) are of different places.
EPS = 0.01


def _stop(s: dict) -> float:
    return max(s["start"], s["end"])


def clusters(old: list[dict], new: list[dict]) -> Iterator[tuple[list[dict], list[dict]]]:
    """Both lists, in order of time, cut into groups that overlap, directly or through others; one side may be empty."""
    old, new = old[::-1], new[::-1]
    while old or new:
        first = min((x[-1]["start"] for x in (old, new) if x))
        group: tuple[list, list] = ([], [])
        # What comes first opens the group; it grows while a next segment of either side begins before its end.
        reach = first + 2 * EPS
        grown = True
        while grown:
            grown = False
            for side, mine in ((old, group[0]), (new, group[1])):
                while side and (side[-1]["start"] < reach - EPS or side[-1]["start"] <= first):
                    mine.append(side.pop())
                    reach = max(reach, _stop(mine[-1]))
                    grown = True
        yield group


def plan(old: list[dict], new: list[dict]) -> list[dict]:
    """Actions on ``old`` (dicts with ``uid, data``) that give ``new`` (data), both in order of time.

    Of segments in one place several are merged first; then the one is split where several are wanted, edited where it
    differs, else accepted.  Surplus ones are deleted, missing ones inserted after what precedes them.
    """
    out: list[dict] = []
    named = {id(s["data"]): s["uid"] for s in old}
    last: object = None  # the name of what precedes, or the number of the action that will have made it
    for had, wanted in clusters([s["data"] for s in old], new):
        uids = [named[id(d)] for d in had]
        if not wanted:
            out += [{"op": "seg.delete", "uid": u, "anchor": d["start"]} for u, d in zip(uids, had)]
            continue
        if not had:
            for d in wanted:
                out.append({"op": "seg.insert", "after": last, "data": d, "anchor": d["start"]})
                last = len(out) - 1
            continue
        at = had[0]["start"]
        if len(uids) > 1:
            out.append({"op": "seg.merge", "uids": uids, "anchor": at})
        if len(wanted) > 1:
            out.append({"op": "seg.split", "uid": uids[0], "parts": wanted, "anchor": at})
            last = len(out) - 1
            continue
        same = len(uids) == 1 and had[0] == wanted[0]
        out.append({"op": "seg.accept", "uid": uids[0], "anchor": at} if same else {"op": "seg.edit", "uid": uids[0], "data": wanted[0], "anchor": at})
        last = uids[0]
    return out


def entity_key(kind: str, e: dict) -> tuple:
    """What two entities of one type must share to be the same, times in tenths of a second."""
    tenth = lambda k: round(float(e.get(k) or 0), 1)
    if kind == "ayat":
        return str(e.get("surah_number")), str(e.get("ayah_number")), tenth("start")
    if kind in ("hadith", "dua"):
        return str(e.get("reference")), tenth("start")
    return (tenth("start"), tenth("end")) if kind == "topics" else (tenth("start"),)


def _numbered(kind: str, items: Iterable[dict], fields: Callable[[dict], dict]) -> dict[tuple, dict]:
    """Items by key and by how manieth they are of it."""
    seen: Counter = Counter()
    out = {}
    for x in items:
        key = entity_key(kind, fields(x))
        seen[key] += 1
        out[key, seen[key]] = x
    return out


def plan_entities(entities: list[dict], wanted: dict[str, list[dict]]) -> list[dict]:
    """Actions on a session's entities that give those ``wanted`` by type: the n-th of a key is paired with the n-th, the rest added or rejected."""

    def action(kind: str, have: dict | None, item: dict | None, place: int | None) -> dict:
        if item is None:
            return {"op": "ent.reject", "uid": have["uid"], "anchor": float(have["fields"].get("start") or 0)}
        what = {"op": "ent.add", "type": kind, "fields": item} if have is None else {"op": "ent.accept", "uid": have["uid"]} if have["fields"] == item else {"op": "ent.edit", "uid": have["uid"], "fields": item, "replace": True}
        return what | {"position": place, "anchor": float(item.get("start") or 0)}

    out = []
    for kind, items in wanted.items():
        had = _numbered(kind, (e for e in entities if e["type"] == kind and e["status"] != "rejected"), lambda e: e["fields"])
        due = _numbered(kind, items, lambda e: e)
        place = {x: i for i, x in enumerate(due)}
        out += [action(kind, had.get(x), due.get(x), place.get(x)) for x in [*due, *(x for x in had if x not in due)]]
    return out


def interleaved(segment_actions: list[dict], entity_actions: list[dict]) -> list[dict]:
    """One list: each segment action, then the entity actions that lie before the next segment action's place.

    An entity action goes to the first segment action up to which some place ahead lies behind it; those behind all come last.
    """
    todo = sorted(entity_actions, key=lambda a: a["anchor"])
    own = [a["anchor"] for a in segment_actions]
    ahead = list(accumulate((max(x, y) for x, y in zip(own, [*own[1:], float("inf")])), max))
    at = [bisect_right(ahead, a["anchor"]) for a in todo]
    out = []
    for i, a in enumerate([*segment_actions, None]):
        out += [a] if a is not None else []
        out += todo[bisect_left(at, i) : bisect_right(at, i)]
    return out


def run_plan(session: Session, actions: list[dict]) -> Session:
    """Take the actions of a plan in order; numbers in ``after`` stand for what that segment action of the plan left last."""
    left: list[str | None] = []
    for a in actions:
        if isinstance(a.get("after"), int):
            a = a | {"after": left[a["after"]]}
        made = session.apply(a)
        if a["op"].startswith("seg."):
            left.append(made[-1] if made else None)
    return session


def plans(old: DataFrame, new: DataFrame) -> DataFrame:
    """``recording, from_ms, n_old, n_new, actions, exact`` for each group of segments of both versions that overlap in time.

    Segments are ``recording, seq, start_ms, end_ms, text``; those without a span are left out.  ``exact`` tells whether the
    actions, taken on the old segments, give the new ones.
    """
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1))).where(F.col("end_ms") > F.col("start_ms")).withColumn("k", F.xxhash64("recording", "side", "seq"))
    # Touching segments are groups of their own: spans are shortened by EPS.
    groups = periods_and_gaps(both.withColumn("e", F.greatest(F.col("end_ms") - int(1000 * EPS), F.col("start_ms") + 1)), ["recording"], "start_ms", "e").where(F.col("kind") == "period").select("recording", F.col("from_ms").alias("g"), F.col("from_ms").alias("g_start"))
    at = last_before(both, groups, "recording", "k", "start_ms", "g", "g_start")

    def run(group: Iterator[tuple]) -> Iterator[tuple]:
        rows = list(group)
        sides = [[{"start": r[4] / 1000, "end": r[5] / 1000, "text": r[6] or ""} for r in rows if r[2] == v] for v in (0, 1)]
        session = Session(sides[0])
        actions = plan(session.segments, sides[1])
        exact = run_plan(session, actions).outputs()[0] == sides[1]
        yield rows[0][0], int(rows[0][1]), len(sides[0]), len(sides[1]), [json.dumps(a, ensure_ascii=False) for a in actions], exact

    rows = both.join(at, "k").select("recording", "g", "side", "start_ms", "seq", "end_ms", "text").select("recording", "g", "side", "seq", "start_ms", "end_ms", "text")
    return apply_groups(rows, ["recording", "g"], ["start_ms", "seq"], run, "recording string, from_ms long, n_old int, n_new int, actions array<string>, exact boolean")


def entity_moves(found: DataFrame, wanted: DataFrame, keys: list[str], order: str, same: Column) -> DataFrame:
    """``keys..., n, move``: accept, edit, reject or add, pairing the rows of equal keys one to one in order.

    ``found`` and ``wanted`` have ``keys``, ``order`` (unique within a key) and the other columns that ``same`` compares, named f_* and w_*.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("n")
    side = lambda df, x: df.select(*keys, number, *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c not in keys], F.lit(True).alias(f"_{x}"))
    j = side(found, "f").join(side(wanted, "w"), [*keys, "n"], "full_outer")
    move = F.when(F.col("_w").isNull(), "reject").when(F.col("_f").isNull(), "add").when(same, "accept").otherwise("edit")
    return j.select(*keys, "n", move.alias("move"))
