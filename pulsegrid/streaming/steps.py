"""State steps shared by the batch folds and the streams.

Each step takes one key's rows in order (a pandas frame) and the key's state, a small
JSON-ready dict, and returns the output rows and the new state.  Replaying a stream in
pieces therefore equals the batch fold.  Times are epoch microseconds.

Steps that the batch fold cuts up have ``passes`` (see :func:`pulsegrid.scale.fold`): what a
piece does to any state that can enter it, as a table over the finite part of the state and
as a step function of the time in it.  Only rows within one waiting time of a piece's begin
can tell entering times apart, so that a summary does not grow with the piece.
"""

from __future__ import annotations

import bisect
import collections

import numpy as np
import pandas as pd


def forgetting(step, zero: dict, ttl_s: float, us="us"):
    """A step whose key starts anew once it has been silent for longer than ``ttl_s``.

    The state gets ``at``, the time of the last row."""
    ttl = int(ttl_s * 1_000_000)

    def inner(state: dict, t: int) -> dict:
        """The state that a row at ``t`` finds."""
        now = {k: v for k, v in state.items() if k != "at"}
        return dict(zero) if state["at"] is None or t - state["at"] > ttl else now

    def parts(rows: pd.DataFrame) -> list[pd.DataFrame]:
        t = rows[us].to_numpy("int64")
        edges = [0, *(np.flatnonzero(np.diff(t) > ttl) + 1).tolist(), len(t)]
        return [rows.iloc[a:b].reset_index(drop=True) for a, b in zip(edges, edges[1:])]

    def run(rows: pd.DataFrame, state: dict):
        made, now = [], state
        for part in parts(rows):
            out, now = step(part, inner(now, int(part[us].iloc[0])))
            now = {**now, "at": int(part[us].iloc[-1])}
            made.append(out)
        return pd.concat(made, ignore_index=True), now

    def passing(summarise, follow):
        def whole(rows: pd.DataFrame, entry: dict | None):
            first, *rest = parts(rows)
            begin, end = int(first[us].iloc[0]), int(rows[us].iloc[-1])
            # after a silence within the piece nothing of the entry is left
            after = step(rest[-1], dict(zero))[1] if rest else None
            return {"begin": begin, "end": end, "after": after,
                    "piece": None if rest else summarise(first, entry and inner(entry, begin))}

        def through(piece: dict, state: dict) -> dict:
            now = piece["after"] if piece["after"] is not None else follow(piece["piece"], inner(state, piece["begin"]))
            return {**now, "at": piece["end"]}
        return whole, through

    run.passes = [passing(*p) for p in getattr(step, "passes", [])]
    run.lists = getattr(step, "lists", {})
    run.expires = lambda state: state["at"] + ttl
    return run


def temperature(col="value", low=60.0, high=80.0, memory=100, warm=20):
    """Out of range, else two deviations off the last ``memory`` values once more than
    ``warm`` are known."""
    def step(rows: pd.DataFrame, state: dict):
        past = state["h"]
        v = pd.Series(past + rows[col].tolist(), dtype=float)
        r = v.rolling(memory, min_periods=1)
        mean, std, n = r.mean(), r.std(), r.count()
        off = ((v - mean).abs() > 2 * std) & (n > warm)
        kind = np.where((v < low) | (v > high), "threshold_violation", np.where(off, "statistical_outlier", ""))
        kind = kind[len(past):]
        out = rows.assign(kind=kind, confidence=np.select([kind == "threshold_violation", kind == "statistical_outlier"], [0.8, 0.7], 0.0))
        return out[out["kind"] != ""], {"h": v.tail(memory).tolist()}

    step.lists = {"h": "DOUBLE"}
    return step


def energy(col="value", factor=2.0, recent=10):
    """More than ``factor`` times the mean of the last ``recent`` values with this one, once
    more than ``recent`` are known."""
    def step(rows: pd.DataFrame, state: dict):
        past, seen = state["h"], state["n"]
        v = pd.Series(past + rows[col].tolist(), dtype=float)
        mean = v.rolling(recent, min_periods=1).mean()[len(past):].to_numpy()
        n = seen + np.arange(1, len(rows) + 1)
        hit = (n > recent) & (rows[col].to_numpy(float) > mean * factor)
        out = rows.assign(kind="consumption_spike", confidence=0.9)[hit]
        return out, {"h": v.tail(recent).tolist(), "n": int(n[-1])}

    step.lists = {"h": "DOUBLE"}
    return step


def lifecycle(flag="breach", us="us"):
    """open at the first breach, resolve at the first row without one; a breach in between
    refreshes ``last_seen``, which travels with the resolve row."""
    def step(rows: pd.DataFrame, state: dict):
        hit = rows[flag].fillna(False).to_numpy(bool)
        t = rows[us].to_numpy("int64")
        was = np.r_[state["open"] is not None, hit[:-1]]
        opened, closed = hit & ~was, ~hit & was
        first = pd.Series(np.where(opened, t, np.nan)).ffill()
        seen = pd.Series(np.where(hit, t, np.nan)).ffill()
        if state["open"] is not None:
            first, seen = first.fillna(state["open"]), seen.fillna(state["seen"])
        turn = opened | closed
        out = rows.assign(event=np.where(opened, "open", "resolve"))[turn].assign(
            first_us=first[turn].astype("int64").to_numpy(), last_us=seen[turn].astype("int64").to_numpy())
        now = {"open": int(first.iloc[-1]), "seen": int(seen.iloc[-1])} if hit[-1] else {"open": None, "seen": None}
        return out, now

    def summarise(rows: pd.DataFrame, _):
        """The last stretch of breaches, and whether the piece is nothing else."""
        hit, t = rows[flag].fillna(False).to_numpy(bool), rows[us].to_numpy("int64")
        calm = np.flatnonzero(~hit)
        begin = int(calm[-1]) + 1 if len(calm) else 0
        return {"open": int(t[begin]) if hit[-1] else None, "seen": int(t[-1]) if hit[-1] else None, "all": not len(calm)}

    def follow(piece: dict, state: dict) -> dict:
        first = state["open"] if piece["all"] and state["open"] is not None else piece["open"]
        return {"open": first, "seen": piece["seen"]}

    step.passes = [(summarise, follow)]
    return step


def by_time(after: np.ndarray, exits: list) -> dict:
    """A step function of time: entry x leads to the exit of the first row after x, ``after[i]`` being the
    time of row i; runs of equal exits are kept once.  Past the last row the state stays."""
    last = [i for i in range(len(exits)) if i + 1 == len(exits) or exits[i] != exits[i + 1]]
    return {"upto": [int(after[i]) for i in last], "exit": [exits[i] for i in last]}


def at_time(table: dict, x: int):
    """The exit for entry ``x``, or None."""
    i = bisect.bisect_right(table["upto"], x)
    return table["exit"][i] if i < len(table["exit"]) else None


def first_rows(t: np.ndarray, wait: int) -> int:
    """How many rows can be the first after entry + wait, for an entry not after the first row."""
    return min(len(t), int(np.searchsorted(t, t[0] + wait, side="right")) + 1)


def rate_limit(period_s: float, us="us"):
    """Keeps a row only when more than the period has passed since the last kept one."""
    period = int(period_s * 1_000_000)

    def step(rows: pd.DataFrame, state: dict):
        t = rows[us].to_numpy("int64")
        sent = np.zeros(len(t), dtype=bool)
        at = 0 if state["last"] is None else int(np.searchsorted(t, state["last"] + period, side="right"))
        last = state["last"]
        while at < len(t):
            sent[at], last = True, int(t[at])
            at = int(np.searchsorted(t, last + period, side="right"))
        return rows.assign(sent=sent), {"last": last}

    def summarise(rows: pd.DataFrame, _):
        t = rows[us].to_numpy("int64")
        after = np.searchsorted(t, t + period, side="right")
        end = np.where(after < len(t), after, np.arange(len(t)))
        while not np.array_equal(end, end[end]):  # each row leads to the last one sent when it is sent
            end = end[end]
        return by_time(t, t[end[:first_rows(t, period)]].tolist())

    def follow(piece: dict, state: dict) -> dict:
        last = piece["exit"][0] if state["last"] is None else at_time(piece, state["last"] + period)
        return state if last is None else {"last": last}

    step.passes = [(summarise, follow)]
    # a notification after the period finds what a first one finds
    step.expires = lambda state: None if state["last"] is None else state["last"] + period
    return step


def grouping(us="us", wait="group_wait_s", interval="group_interval_s", repeat="repeat_interval_s", new="is_new",
             resolve_s: float = 300.0):
    """When each alert of a group is notified.

    A group starts with its first alert and flushes ``wait`` later, then every
    ``interval``.  New alerts go out at the next flush; known ones only when the last
    notification is at least ``repeat`` old.  A group without alerts for ``resolve_s``
    after its last flush or alert ends."""
    def step(rows: pd.DataFrame, state: dict):
        s = dict(state)
        notify, reason = [], []
        quiet = int(resolve_s * 1_000_000)
        for t, w, i, r, fresh in zip(rows[us].tolist(), rows[wait].tolist(), rows[interval].tolist(),
                                     rows[repeat].tolist(), rows[new].tolist()):
            if s["flush"] is None or t > max(s["seen"], s["flush"]) + quiet:
                s["flush"], why = t + w * 1_000_000, "first"
                s["sent"] = None
            else:
                why = "update"
                if t > s["flush"]:
                    s["flush"] += -((s["flush"] - t) // (i * 1_000_000)) * i * 1_000_000
            s["seen"] = t
            if not fresh and s["sent"] is not None and s["sent"] != s["flush"] and s["flush"] - s["sent"] < r * 1_000_000:
                notify.append(-1)
                reason.append("suppressed")
            else:
                if not fresh and why == "update" and s["sent"] != s["flush"]:
                    why = "repeat"
                s["sent"] = s["flush"]
                notify.append(s["flush"])
                reason.append(why)
        return rows.assign(notify_us=np.array(notify, dtype="int64"), reason=reason), s

    def timing(rows: pd.DataFrame) -> tuple[int, int, int]:
        """The route's timings in microseconds, the same for all alerts of a group."""
        w, i, r = (rows[c].to_numpy("int64") for c in (wait, interval, repeat))
        if (w != w[0]).any() or (i != i[0]).any() or (r != r[0]).any():
            raise ValueError("the alerts of a group need the same timings")
        return int(w[0]) * 1_000_000, int(i[0]) * 1_000_000, int(r[0]) * 1_000_000

    quiet_us = int(resolve_s * 1_000_000)

    def flush_at(flush, t, i):
        """The flush that takes an alert at ``t``, in a group that flushes at ``flush`` and every ``i`` after."""
        return flush + np.maximum(0, -((flush - t) // i)) * i

    def when(rows: pd.DataFrame, _):
        """The pauses after which the group may have ended; the others it has surely outlasted."""
        t, (w, i, _) = rows[us].to_numpy("int64"), timing(rows)
        gap = np.flatnonzero(np.diff(t) > quiet_us)
        return {"first": int(t[0]), "last": int(t[-1]), "wait": w, "every": i, "pauses": [[int(t[k]), int(t[k + 1])] for k in gap]}

    def follow_when(piece: dict, state: dict) -> dict:
        flush, seen = state["flush"], state["seen"]
        for before, t in [[seen, piece["first"]], *piece["pauses"]]:
            if flush is not None:
                flush = int(flush_at(flush, before, piece["every"]))
            if flush is None or t > max(before, flush) + quiet_us:
                flush = t + piece["wait"]
        return {"flush": int(flush_at(flush, piece["last"], piece["every"])), "seen": piece["last"], "sent": None}

    def flushes(rows: pd.DataFrame, entry: dict) -> tuple[np.ndarray, np.ndarray]:
        """Each alert's flush, and whether its group starts with it."""
        t, (w, i, _) = rows[us].to_numpy("int64"), timing(rows)
        flush, first = np.empty(len(t), np.int64), np.zeros(len(t), bool)
        now, seen, at = entry["flush"], entry["seen"], 0
        for end in [*(np.flatnonzero(np.diff(t) > quiet_us) + 1).tolist(), len(t)]:
            if now is None or t[at] > max(seen, now) + quiet_us:
                now, first[at] = int(t[at]) + w, True
            flush[at:end] = flush_at(now, t[at:end], i)
            now, seen, at = int(flush[end - 1]), int(t[end - 1]), end
        return flush, first

    def sent(rows: pd.DataFrame, entry: dict):
        """The last notification by the one before the piece: known alerts go out with a flush that is late
        enough after it, new ones and the first of a group with any."""
        flush, first = flushes(rows, entry)
        r = timing(rows)[2]
        fresh = rows[new].to_numpy(bool) | first
        at = np.flatnonzero(np.r_[True, flush[1:] != flush[:-1]])
        window, forced = flush[at], np.logical_or.reduceat(fresh, at)
        ahead = np.where(forced, np.arange(len(at)), len(at))  # the next flush that goes out whatever was before
        ahead = np.minimum.accumulate(ahead[::-1])[::-1]
        due = np.searchsorted(window, window + r)
        after = np.minimum(due, np.append(ahead[1:], len(at)))
        end = np.where(after < len(at), after, np.arange(len(at)))
        while not np.array_equal(end, end[end]):
            end = end[end]
        # the entry decides up to the first flush that goes out anyway, by itself or for being so late
        free = min(int(ahead[0]), int(np.searchsorted(window, window[0] + r)))
        some = min(free, len(at) - 1) + 1
        return {"upto": window[:some].tolist(), "exit": window[end[:some]].tolist(), "forced": free < len(at), "flush": int(flush[-1]),
                "seen": int(rows[us].iloc[-1]), "repeat": r}

    def follow_sent(piece: dict, state: dict) -> dict:
        last = state["sent"]
        if last is None:
            out = piece["exit"][0]
        else:
            # the flush that the piece begins in may have gone out before it
            k = bisect.bisect_left(piece["upto"], last + piece["repeat"])
            k = 0 if last == piece["upto"][0] else k
            if k >= len(piece["exit"]) and piece["forced"]:
                k = len(piece["exit"]) - 1
            out = piece["exit"][k] if k < len(piece["exit"]) else last
        return {"flush": piece["flush"], "seen": piece["seen"], "sent": out}

    step.passes = [(when, follow_when), (sent, follow_sent)]
    step.expires = lambda state: max(state["seen"], state["flush"]) + quiet_us
    return step


def earliest_open(window_s: float, us="us", end="end_us", id="id"):
    """The earliest earlier row that is still open, and not older than the window.

    Open rows are kept by start; one that ends no later than an earlier one is never the earliest, so
    that ends ascend too and what has ended is at the front."""
    window = int(window_s * 1_000_000)

    def step(rows: pd.DataFrame, state: dict):
        held, found, top = collections.deque(state["open"]), [], state["top"]
        for t, e, i in zip(rows[us].tolist(), rows[end].tolist(), rows[id].tolist()):
            while held and held[0][1] <= t:
                held.popleft()
            found.append(held[0][0] if held else None)
            e = t + window + 1 if e is None or e != e else min(int(e), t + window + 1)
            if e > t and (not held or e > held[-1][1]):
                held.append((i, e))
            top = t
        while held and held[0][1] <= top:
            held.popleft()
        return rows.assign(parent=pd.Series(found, index=rows.index, dtype=object)), {"open": list(held), "top": top}

    def summarise(rows: pd.DataFrame, _):
        return step(rows, {"open": [], "top": None})[1]

    def follow(piece: dict, state: dict) -> dict:
        last = max((e for _, e in state["open"]), default=None)
        both = state["open"] + [x for x in piece["open"] if last is None or x[1] > last]
        return {"open": [x for x in both if x[1] > piece["top"]], "top": piece["top"]}

    step.passes = [(summarise, follow)]
    return step


def breaker(failures=5, recovery_s=60.0, successes=3, us="us", ok="success"):
    """Circuit-breaker replay: state after each request, and whether it was let through."""
    wait = int(recovery_s * 1_000_000)

    def step(rows: pd.DataFrame, state: dict):
        st, f, s, last = state["state"], state["f"], state["s"], state["last"]
        states, passed, counts = [], [], []
        for t, good in zip(rows[us].tolist(), rows[ok].tolist()):
            if st == "open" and t - last > wait:
                st, s = "half_open", 0
            go = st != "open"
            if go and good:
                if st == "half_open":
                    s += 1
                    if s >= successes:
                        st, f = "closed", 0
                else:
                    f = max(0, f - 1)
            elif go:
                f, last = f + 1, t
                if st == "half_open" or f >= failures:
                    st = "open"
            states.append(st)
            passed.append(go)
            counts.append(f)
        return rows.assign(state=states, executed=passed, failures=np.array(counts, dtype="int64")), \
            {"state": st, "f": f, "s": s, "last": last}

    def summarise(rows: pd.DataFrame, _):
        """Exits by entry, from the last row backwards.  An exit is (state, failures, successes, last, from
        here): failures count on from the entry's unless the breaker closes on the way."""
        t, good = rows[us].to_numpy("int64"), rows[ok].to_numpy(bool)
        after = np.searchsorted(t, t + wait, side="right").tolist()
        more = lambda e, k, fixed: (e[0], e[1] + k, e[2], e[3], e[4] and not fixed) if e[4] else e
        closed = [("closed", f, 0, None, False) for f in range(failures)]
        half = [("half_open", 0, s, None, True) for s in range(successes)]
        begun = [None] * len(t)  # exits of a half-open breaker at each row
        for i in range(len(t) - 1, -1, -1):
            if good[i]:
                half = [*half[1:], closed[0]]
                closed = [closed[0], *closed[:-1]]
            else:
                opened = begun[after[i]] if after[i] < len(t) else ("open", 0, 0, int(t[i]), True)
                closed = [*closed[1:], more(opened, failures, True)]
                half = [more(opened, 1, False)] * successes
            begun[i] = half[0]
        return {"closed": closed, "half": half, "open": by_time(t, begun[:first_rows(t, wait)])}

    def follow(piece: dict, state: dict) -> dict:
        if state["state"] == "open":
            e = at_time(piece["open"], state["last"] + wait)
            if e is None:
                return state
        else:
            e = piece["closed"][state["f"]] if state["state"] == "closed" else piece["half"][state["s"]]
        return {"state": e[0], "f": e[1] + (state["f"] if e[4] else 0), "s": e[2], "last": state["last"] if e[3] is None else e[3]}

    step.passes = [(summarise, follow)]
    return step


BREAKER_ZERO = {"state": "closed", "f": 0, "s": 0, "last": None}


def recovery(limit=3, ok="success"):
    """Recovery attempts: reset on success; once ``limit`` attempts in a row have failed the
    service is blocked for good."""
    def step(rows: pd.DataFrame, state: dict):
        good = rows[ok].fillna(False).to_numpy(bool)
        n, blocked = state["n"], state["blocked"]
        pos = np.arange(len(good))
        last_good = np.maximum.accumulate(np.where(good, pos, -1))
        run = np.where(last_good >= 0, pos - last_good, pos + 1 + n)
        full = np.flatnonzero(run >= limit)
        stop = 0 if blocked or n >= limit else int(full[0]) + 1 if len(full) else len(good)
        tried = pos < stop
        attempts = np.where(tried, run, limit if stop < len(good) or blocked else 0)
        out = rows.assign(action=np.where(tried, "attempt", "blocked"), attempts=attempts.astype("int64"))
        return out, {"n": int(attempts[-1]), "blocked": bool(blocked or stop < len(good))}

    def summarise(rows: pd.DataFrame, _):
        return [step(rows, {"n": n, "blocked": False})[1] for n in range(limit + 1)]

    def follow(piece: list, state: dict) -> dict:
        return state if state["blocked"] else piece[min(state["n"], limit)]

    step.passes = [(summarise, follow)]
    return step


def history(memory=1000, ttl_s=86400.0, us="us"):
    """Size of a history that forgets rows older than the TTL and beyond ``memory`` rows."""
    ttl = int(ttl_s * 1_000_000)

    def step(rows: pd.DataFrame, state: dict):
        past = np.array(state["t"], dtype="int64")
        t = np.r_[past, rows[us].to_numpy("int64")]
        at = np.arange(len(past), len(t))
        size = np.minimum(at - np.searchsorted(t, t[at] - ttl, side="left") + 1, memory)
        keep = t[max(0, len(t) - memory):]
        return rows.assign(history_size=size.astype("int64")), {"t": keep[keep >= t[-1] - ttl].tolist()}

    step.lists = {"t": "BIGINT"}
    step.expires = lambda state: state["t"][-1] + ttl
    return step
