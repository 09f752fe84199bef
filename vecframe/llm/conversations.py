"""Conversations from message rows: a range-partitioned sort by key and instant, then scans of adjacent rows.

The key is what messages share: participants, a channel, or a session that the table names. Pauses between adjacent
messages of a key are counted by their length; the valley of the counts calibrates the gap of inactivity at which a key is
cut into sessions. Where the table names its conversations, the sessions of one name are put together again, so gaps
decide nothing there. Roles that are not given are inferred from who opens a key.

Keys are not grouped: one that holds a third of all rows is cut over many partitions. A scan of a partition meets at most
two sessions that may go on beyond its ends; their parts are summed up in short rows, put together on the driver (two rows
a partition at most), and the last scan then knows their offset and fate.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.runtime import materialize, spread, trim_blank

# Spellings of the roles, lower case.
ROLES = {"user": 1, "human": 1, "assistant": 2, "bot": 2, "ai": 2, "system": 0}
#: Neither blank nor control or format character, nor one of the letters that show nothing.
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{115F}\x{1160}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"
_ISO = r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?) ?(Z|z|[+-]\d\d):?(\d\d)?$"


def instant(sent: Column) -> Column:
    """Microseconds of unix milliseconds or of an ISO 8601 text with an offset; null if it is neither."""
    text = trim_blank(sent)
    iso = F.regexp_replace(text, _ISO, "$1T$2$3:$4")
    stamp = F.regexp_replace(F.regexp_replace(iso, r"[Zz]:$", "Z"), r"([+-]\d\d):$", "$1:00")
    millis = F.when(text.rlike(r"^[+-]?\d{1,15}$"), text).try_cast("long") * 1000
    return F.coalesce(millis, F.unix_micros(F.when(text.rlike(_ISO), stamp).try_cast("timestamp")))


def role_code(role: Column) -> Column:
    """0 system, 1 user, 2 assistant; null of any other role. Case and blanks are ignored."""
    bare = F.lower(F.regexp_replace(role, r"[\s\p{Z}]+", ""))
    return F.coalesce(*[F.when(bare == k, F.lit(v)) for k, v in ROLES.items()])


class _Part(NamedTuple):
    """Some adjacent messages of a session, counted from its first one there; parities are those of the turn numbers."""

    n: int
    bad: bool
    system: int
    last_system: int
    user_even: bool
    user_odd: bool
    other_even: bool
    other_odd: bool

    def then(self, b: _Part) -> _Part:
        flip = self.n % 2
        ue, uo = (b.user_odd, b.user_even) if flip else (b.user_even, b.user_odd)
        oe, oo = (b.other_odd, b.other_even) if flip else (b.other_even, b.other_odd)
        last = b.last_system + self.n if b.last_system else self.last_system
        return _Part(self.n + b.n, self.bad or b.bad, self.system + b.system, last, self.user_even or ue, self.user_odd or uo, self.other_even or oe, self.other_odd or oo)

    def kept(self) -> bool:
        if self.bad or self.last_system != self.system or self.n - self.system < 2 or (self.n - self.system) % 2:
            return False
        return not (self.user_even or self.other_odd) if self.system % 2 == 0 else not (self.user_odd or self.other_even)


_NONE = _Part(0, False, 0, 0, False, False, False, False)


def _parts(role: np.ndarray, bad: np.ndarray, starts: np.ndarray) -> list[_Part]:
    turn = np.arange(len(role)) - np.repeat(starts, np.diff([*starts, len(role)])) + 1
    odd = turn % 2 == 1
    sums = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    system = role == 0
    last = np.maximum.reduceat(np.where(system, turn, 0), starts)
    cols = (np.diff([*starts, len(role)]), sums(bad) > 0, sums(system), last, sums((role == 1) & ~odd) > 0, sums((role == 1) & odd) > 0, sums((role == 2) & ~odd) > 0, sums((role == 2) & odd) > 0)
    return [_Part(*x) for x in zip(*(c.tolist() for c in cols))]


def calibrated_gap(counts: dict[int, int], least: int = 60_000_000) -> int | None:
    """Microseconds of inactivity that part two sessions, from the pauses counted by the half powers of two of their length.

    The split of the logarithms into two groups of least spread within them (Otsu's), if its valley is much lower than
    both groups' peaks, and ``least`` at least; None if the pauses are of one kind.
    """
    bins = np.arange(min(counts, default=0), max(counts, default=0) + 1)
    n = np.array([counts.get(int(b), 0) for b in bins], float)
    if n.sum() < 2 or len(bins) < 3:
        return None
    below, total = np.cumsum(n), n.sum()
    sums = np.cumsum(n * bins)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((sums[-1] * below / total - sums) ** 2 / (below * (total - below)), posinf=0)
    best = np.flatnonzero(between >= between.max() * (1 - 1e-9))
    cut = int(best[len(best) // 2])  # the middle of an empty valley
    low, high = n[: cut + 1].max(), n[cut + 1 :].max(initial=0)
    if not high or n[cut] > 0.5 * min(low, high):
        return None
    return max(least, int(2 ** ((bins[cut] + 1) / 2)))


def _pauses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bin, n): the pauses between adjacent messages of a key in this partition, by twice the logarithm of their length."""
    counts: dict[int, int] = {}
    key = at = None
    for b in batches:
        if len(b):
            keys, times = b["session"].to_numpy(object), b["at"].to_numpy(np.float64)
            same = keys == np.concatenate([np.array([key], object), keys[:-1]])
            pause = times - np.concatenate([[np.nan if at is None else at], times[:-1]])
            known = pause[same & (pause >= 1)]
            for k, c in zip(*np.unique(np.floor(2 * np.log2(known)).astype(np.int64), return_counts=True)):
                counts[int(k)] = counts.get(int(k), 0) + int(c)
            key, at = keys[-1], times[-1]
    yield pd.DataFrame({"bin": list(counts), "n": list(counts.values())}).astype("int64")


def _sessions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, _Part, list[np.ndarray], bool]]:
    """Each session of a sorted partition: name, its part, its message ids and roles, and whether it is the last one."""
    name, part, ids, last = None, _NONE, [], None
    for b in batches:
        session, mid = b["session"].to_numpy(object), b["id"].to_numpy(np.int64)
        if not len(mid):
            continue
        new = session != np.concatenate([np.array([name], object), session[:-1]])
        again = ~new & (mid == np.concatenate([[mid[0] - 1 if last is None else last], mid[:-1]])) & (mid >= 0)
        b, session, mid, new, last = b[~again], session[~again], mid[~again], new[~again], int(mid[-1])
        if not len(mid):
            continue
        cuts = np.flatnonzero(new)
        starts = cuts if len(cuts) and cuts[0] == 0 else np.concatenate([[0], cuts])
        rows = np.stack([mid, b["role"].to_numpy(np.int64)])
        for i, p in enumerate(_parts(rows[1], b["bad"].to_numpy(bool), starts)):
            at, end = starts[i], starts[i + 1] if i + 1 < len(starts) else len(mid)
            if new[at]:
                if name is not None:
                    yield name, part, ids, False
                name, part, ids = session[at], _NONE, []
            part = part.then(p)
            ids.append(rows[:, at:end])
    if name is not None:
        yield name, part, ids, True


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    context = TaskContext.get()
    pid = context.partitionId() if context else 0
    for i, (name, part, _, last) in enumerate(_sessions(batches)):
        if i == 0 or last:
            yield pd.DataFrame([{"pid": pid, "session": name, **part._asdict()}])


def _emit(shared):
    def frame(sessions: list) -> pd.DataFrame:
        names, sizes, turns, rows = zip(*sessions)
        whole = np.concatenate(rows, axis=1)
        return pd.DataFrame({"session": np.repeat(np.array(names, object), sizes), "turn": np.concatenate(turns), "id": whole[0], "role": whole[1]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        pid, fate = context.partitionId() if context else 0, shared.value
        out, size = [], 0
        for name, part, pieces, _ in _sessions(batches):
            offset, kept = fate.get((pid, name)) or (0, part.kept())
            if not kept:
                continue
            rows = pieces[0] if len(pieces) == 1 else np.concatenate(pieces, axis=1)
            out.append((name, part.n, np.arange(1 + offset, part.n + offset + 1), rows))
            size += part.n
            if size > 20_000:
                yield frame(out)
                out, size = [], 0
        if out:
            yield frame(out)

    return scan


def inferred_roles(df: DataFrame, key: Column, speaker: Column, at: Column, id_col: str) -> DataFrame:
    """``df`` with ``inferred_role``: of each key the speaker of its first message is the user, all others are assistants.

    For tables that name speakers and no roles. A null speaker has no role. Speakers are summed up to one row each
    before they meet, so that no key is held in one task; a hot key's one row is broadcast or left to a skew join.
    """
    rows = df.withColumns({"_key": key, "_speaker": speaker})
    first = rows.where("_key is not null and _speaker is not null").groupBy("_key").agg(F.min_by("_speaker", F.struct(at, F.col(id_col))).alias("_opener"))
    role = F.when(F.col("_speaker") == F.col("_opener"), "user").when(F.col("_speaker").isNotNull(), "assistant")
    return rows.join(first, "_key", "left").withColumn("inferred_role", role).drop("_key", "_speaker", "_opener")


def conversations(df: DataFrame, session: Column, role: Column, content: Column, sent: Column, seq: Column, id_col: str, named: bool = True, gap: int | None = None) -> DataFrame:
    """(session, turn, id, role): the messages of each whole conversation in order, turns from 1, roles system, user, assistant.

    A session is kept if every message has a known role, a readable instant, visible content and an id, and if after any
    leading system messages user and assistant take turns, a user first and an assistant last, at least once. Messages go
    by instant, then seq (null first), then id; an id that is delivered more than once counts once. Rows with a null or
    blank session belong to no conversation; an empty table gives no rows.

    named: ``session`` names conversations, whatever the pauses in them. Else it is a key such as the participants or a
    channel: it is cut where a pause is longer than ``gap`` microseconds, by default the calibrated one, and the sessions
    are named by the key, ``#`` and the microseconds of their first message; messages without a readable instant belong to none.
    """
    name = trim_blank(session)
    rows = df.select(name.alias("session"), instant(sent).alias("at"), seq.cast("long").alias("seq"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.coalesce(role_code(role), F.lit(9)).alias("role"), content.rlike(VISIBLE).alias("shown"))
    rows = rows.where("session is not null and session <> ''")
    bad = F.col("at").isNull() | (F.col("role") == 9) | (F.col("id") < 0) | ~F.coalesce("shown", F.lit(False))
    by = ["session", "at", "seq", "id"]
    parsed = materialize(spread(rows.select(*by, "role", bad.alias("bad"))))  # written before the sampler of ranges reads it
    ordered = materialize(parsed.repartitionByRange(*by).sortWithinPartitions(*by))
    if not named:
        ordered = _cut(ordered.where("at is not null"), gap)
    schema = "pid int, session string, n long, bad boolean, system long, last_system long, user_even boolean, user_odd boolean, other_even boolean, other_odd boolean"
    edges: dict[str, list[tuple[int, _Part]]] = {}
    for pid, key, *part in sorted(map(tuple, ordered.mapInPandas(_edges, schema).collect())):
        edges.setdefault(key, []).append((pid, _Part(*part)))
    fate = {}
    for key, parts in edges.items():
        whole = _NONE
        offsets = []
        for _, p in parts:
            offsets.append(whole.n)
            whole = whole.then(p)
        fate |= {(pid, key): (offset, whole.kept()) for (pid, _), offset in zip(parts, offsets)}
    code = F.col("role")
    text = F.when(code == 0, "system").when(code == 1, "user").otherwise("assistant")
    shared = df.sparkSession.sparkContext.broadcast(fate)
    return ordered.mapInPandas(_emit(shared), "session string, turn long, id long, role int").select("session", "turn", "id", text.alias("role"))


def gap_of(ordered: DataFrame) -> int | None:
    """The calibrated gap of rows sorted by key and instant within their partitions."""
    counts = ordered.mapInPandas(_pauses, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect()  # some 120 bins at most
    return calibrated_gap(dict(map(tuple, counts)))


def _begun(times: np.ndarray, before: tuple[float, float] | None, gap: int | None) -> np.ndarray:
    """The first instant of each message's session; ``before``: that of the last message so far, and its instant."""
    if before is not None:
        times = np.concatenate([[before[1]], times])
    new = np.concatenate([[True], np.isnan(times[:-1]) | (np.diff(times) > (np.inf if gap is None else gap))])
    first = times[np.maximum.accumulate(np.where(new, np.arange(len(times)), 0))]
    if before is None:
        return first
    first[: int(np.argmax(np.append(new[1:], True))) + 1] = before[0]  # up to the first gap it is still the session before
    return first[1:]


def _cut(ordered: DataFrame, gap: int | None) -> DataFrame:
    """The rows with each key cut at its gaps; what a partition goes on from is known from the ends of those before it."""
    gap = gap_of(ordered) if gap is None else gap

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first = key = before = None
        inside = False
        for b in batches:
            for k, rows in b.groupby("session", sort=False):
                times = rows["at"].to_numpy(np.float64)
                begun = _begun(times, before if k == key else None, gap)
                inside |= key is not None and k != key or bool((begun != (begun[0] if before is None or k != key else before[0])).any())
                first = first or (k, float(times[0]))
                key, before = k, (float(begun[-1]), float(times[-1]))
        if first is not None:
            yield pd.DataFrame([{"pid": TaskContext.get().partitionId(), "first": first[0], "since": first[1], "last": key, "begun": before[0], "at": before[1], "inside": inside}])

    carried, before = {}, None
    schema = "pid int, first string, since double, last string, begun double, at double, inside boolean"
    for r in sorted(ordered.mapInPandas(ends, schema).collect(), key=lambda r: r["pid"]):
        carried[r["pid"]] = before
        goes_on = not r["inside"] and before is not None and before[0] == r["first"] and (gap is None or r["since"] - before[2] <= gap)
        before = (r["last"], before[1] if goes_on else r["begun"], r["at"])
    shared = ordered.sparkSession.sparkContext.broadcast(carried)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        key, *before = shared.value.get(TaskContext.get().partitionId()) or (None, None, None)
        for b in batches:
            names = []
            for k, rows in b.groupby("session", sort=False):
                times = rows["at"].to_numpy(np.float64)
                begun = _begun(times, tuple(before) if k == key else None, gap)
                names += [f"{k}#{int(x)}" for x in begun]
                key, before = k, (float(begun[-1]), float(times[-1]))
            yield b.assign(session=names)

    return materialize(ordered.mapInPandas(cut, ordered.schema))


def p4_conversations(messages: DataFrame) -> DataFrame:
    c = F.col
    return conversations(messages, c("session_id"), c("speaker_role"), c("content"), c("sent_ms"), c("seq_no"), "message_id")
