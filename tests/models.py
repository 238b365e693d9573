"""Plain per-event models of the sequential operators, written from their described rules."""

from __future__ import annotations


def ema(values, alpha):
    out, m = [], None
    for x in values:
        m = x if m is None else alpha * x + (1 - alpha) * m
        out.append(m)
    return out


def extremes(points, levels):
    """Extremes [(level, ts, price, flag)] of one path; points are (ts, price)."""
    marks, tops, bottoms, last, found = {}, {}, {}, {}, []

    def feed(n, ts, price, flag):
        if n > levels:
            return
        if n not in marks:
            marks[n] = (ts, price)
            feed(n + 1, ts, price, 0)
            return
        e, new = last.get(n), 0
        if flag == 0:
            cand = marks[n]
            if cand[1] > price and (e is None or e[2] == -1):
                new = 1
            elif cand[1] < price and (e is None or e[2] == 1):
                new = -1
        else:
            book = tops if flag == 1 else bottoms
            old = book.get(n)
            cand = old or marks[n]
            book[n] = (ts, price)
            if old is None or e is None:
                new = flag
            elif flag == 1 and e[1] < cand[1] and cand[1] > price or flag == -1 and e[1] > cand[1] and cand[1] < price:
                new = flag
        marks[n] = (ts, price)
        if new:
            last[n] = (*cand, new)
            found.append((n, cand[0], cand[1], new))
            feed(n + 1, cand[0], cand[1], new)

    for ts, price in points:
        feed(0, ts, price, 0)
    return found


def wave_target(points, marks, alpha, look_back):
    """Rows {ts: dict} of the targets; marks are (ts, price, flag) in order."""
    out = {ts: {"state": 0, "hi": None, "lo": None} for ts, _ in points}
    for k, (ts, _, flag) in enumerate(marks):
        end = marks[k + 1][0] if k + 1 < len(marks) else points[-1][0]
        inside = [(t, p) for t, p in points if ts <= t <= end]
        for i, (t, _) in enumerate(inside):
            out[t] = {"state": -flag, "hi": max(p for _, p in inside[i:]), "lo": min(p for _, p in inside[i:])}
    price = dict(points)
    for t, r in out.items():
        r["up"] = None if r["hi"] is None else r["hi"] / price[t] - 1
        r["down"] = None if r["lo"] is None else r["lo"] / price[t] - 1
        r["target"] = None if r["hi"] is None else r["up"] if r["state"] == 1 else r["down"] if r["state"] == -1 else r["up"] + r["down"]
        r["s_up"], r["s_down"], r["s_target"] = r["up"], r["down"], r["target"]
    for (pt, _, _), (ct, _, flag), (_, np_, _) in zip(marks, marks[1:], marks[2:]):
        rows = [t for t, _ in points if max(ct - look_back, pt) <= t <= ct]
        worst = [out[t]["down"] if flag == -1 else -out[t]["up"] for t in rows]
        loss = [min(worst[i:]) for i in range(len(rows))]
        thr = max(min(loss), -alpha)
        for t, x in zip(rows, loss):
            r, change = out[t], np_ / price[t] - 1
            hold = 1 - x / thr if x > thr else 0
            gain = max(change, 0) if flag == -1 else min(change, 0)
            if flag == -1:
                r["s_up"], r["s_target"] = hold * gain + (1 - hold) * r["up"], hold * gain + (1 - hold) * r["s_down"]
            else:
                r["s_down"], r["s_target"] = hold * gain + (1 - hold) * r["down"], hold * gain + (1 - hold) * r["s_up"]
    return out


def adaptive_bars(events, interval, sample_size, window):
    """Bar number of each (ts, volume); everything is worked out anew from all events so far."""
    out, at, bar = [], None, -1
    for n in range(1, len(events) + 1):
        seen, acc, ends = events[:n], 0.0, {}
        for ts, v in seen:
            acc += v
            ends[ts // interval] = acc - seen[0][1]  # the first event's own volume is left out
        totals = list(ends.values())
        volumes = [b - a for a, b in zip([0.0, *totals], totals)]
        ts, base = seen[-1][0], None
        if len(volumes) > window:
            base = sum(volumes[:window]) / window
        elif len(volumes) >= min(sample_size, window // 2):
            passed = ts - ts // interval * interval
            values = volumes[:-1] + ([volumes[-1] / max(1, passed) * interval] if passed > interval / 2 else [])
            base = sum(values) / len(values) if values and sum(values) > 0 else None
        now = (ts // interval, 0) if base is None else (0, acc // base)
        if at is None or now[0] > at[0] or now[1] > at[1]:
            at, bar = now, bar + 1
        out.append(bar)
    return out


def profile_bars(events, interval, length, window):
    """Bar number of each (elapsed, volume) of a day; the forecast is worked out anew from all events so far."""

    def forecast(seen):
        by = {}
        for e, v in seen:
            by[e // interval] = by.get(e // interval, 0.0) + v
        n = 0
        while n in by:
            n += 1
        return sum(by[i] for i in range(n)) / seen[-1][0] * length if n >= window / 2 and seen[-1][0] > 0 else None

    out, bucket, last, bar, frozen = [], None, 0, 0, None
    for n, (e, _) in enumerate(events, 1):
        if frozen is None and e // interval >= window and n > 1:
            frozen = forecast(events[: n - 1])
        if bucket is None:
            day = frozen if frozen is not None else forecast(events[:n])
            bucket = day / (length / interval) if day else None
        idx = e // interval if bucket is None else sum(v for _, v in events[:n]) // bucket
        if idx > last:
            bar, bucket = bar + 1, None
        last = idx
        out.append(bar)
    return out
