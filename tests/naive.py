"""Plain Python state machines that the Spark operators are compared with."""

import math
from dataclasses import dataclass


def debounce(rows, n):
    """rows: (frame, state) in order -> confirmed rows and transitions."""
    confirmed = candidate = last = None
    count = streak = 0
    out, changes = [], []
    for frame, state in rows:
        if last is not None and frame != last + 1:
            candidate, count, streak = None, 0, 0
        last = frame
        if state == "UNKNOWN":
            candidate, count, streak = None, 0, 0
            out.append((frame, "UNKNOWN", True))
            continue
        if state == confirmed:
            candidate, count = None, 0
            out.append((frame, state, False))
            continue
        candidate, count = (candidate, count + 1) if candidate == state else (state, 1)
        if count < n:
            out.append((frame, confirmed or "UNKNOWN", True))
            continue
        if confirmed is not None:
            changes.append((frame, confirmed, state))
        confirmed, candidate, count = state, None, 0
        out.append((frame, state, False))
    return out, changes


def presence(seen, first, last, minimum, maximum):
    events = []
    alive, streak, missed, announced = False, 0, 0, False
    for frame in range(first, last + 1):
        if frame in seen:
            alive, streak, missed = True, streak + 1, 0
            if not announced and streak >= minimum:
                announced = True
                events.append(("appeared", frame))
        elif alive:
            streak, missed = 0, missed + 1
            if missed >= maximum:
                events.append(("disappeared" if announced else "retired", frame))
                alive, streak, missed, announced = False, 0, 0, False
    return events


def throttle(times, interval):
    last, out = None, []
    for t in times:
        if last is None or t - last >= interval:
            last = t
            out.append(t)
    return out


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def identities(frames, threshold=0.3, reconnect=3, misses=8):
    """frames: list of lists of (class, box, raw id) -> list of lists of ids."""
    tracks, raw, following, out = {}, {}, 1, []
    for detections in frames:
        got = {}
        for i, (cls, box, tag) in enumerate(detections):
            owner = raw.get((cls, tag)) if tag is not None else None
            if owner in tracks and owner not in got.values():
                got[i] = owner
        pairs = []
        for i, (cls, box, _) in enumerate(detections):
            for owner, t in tracks.items():
                if i not in got and owner not in got.values() and t["missed"] <= reconnect:
                    if t["cls"] == cls and iou(box, t["box"]) >= threshold:
                        pairs.append((-iou(box, t["box"]), owner, i))
        for _, owner, i in sorted(pairs):
            if i not in got and owner not in got.values():
                got[i] = owner
        for i, (cls, box, _) in enumerate(detections):
            if i not in got:
                got[i] = following
                tracks[following] = {"cls": cls, "box": box, "missed": 0}
                following += 1
        for i, (cls, box, tag) in enumerate(detections):
            tracks[got[i]].update(box=box, missed=0)
            if tag is not None:
                owner = raw.get((cls, tag))
                if owner is None or owner == got[i] or owner not in tracks:
                    raw[(cls, tag)] = got[i]
        out.append([got[i] for i in range(len(detections))])
        for owner in list(tracks):
            if owner not in got.values():
                tracks[owner]["missed"] += 1
                if tracks[owner]["missed"] >= misses:
                    del tracks[owner]
                    raw = {k: v for k, v in raw.items() if v != owner}
    return out


def turns(flags, silence, prefix, minimum, longest, frame_ms=20):
    out, speaking, recent, buffered = [], False, [], []
    quiet = speech = count = first = 0
    keep = max(1, prefix // frame_ms)
    for i, flag in enumerate(flags):
        if not speaking:
            recent, buffered = (recent + [flag])[-5:], (buffered + [i])[-keep:]
            if sum(recent) >= 3:
                speaking, first, count = True, buffered[0], len(buffered)
                speech, quiet = sum(recent) * frame_ms, 0
            continue
        count += 1
        quiet = 0 if flag else quiet + frame_ms
        speech += frame_ms if flag else 0
        forced = count * frame_ms >= longest
        if quiet >= silence or forced:
            out.append((first, i, speech, forced, speech < minimum))
            speaking, recent, buffered = False, [], []
    return out


def queue(ticks, capacity, cooldown):
    """ticks: list of (now, [(seq, message, priority, key, ttl)]) -> said messages."""
    waiting, said, order, out = [], {}, 0, []
    for now, candidates in ticks:
        waiting = [w for w in waiting if w["expires"] > now]
        said = {k: t for k, t in said.items() if now < t or now - t < cooldown}
        for seq, message, priority, key, ttl in candidates:
            if message is None or ttl == 0 or key in said or any(w["key"] == key for w in waiting):
                continue
            item = dict(p=priority, o=order, expires=now + ttl, key=key, seq=seq, message=message)
            order += 1
            if len(waiting) >= capacity:
                worst = max(waiting, key=lambda w: (w["p"], w["o"]))
                if priority >= worst["p"]:
                    continue
                waiting.remove(worst)
            waiting.append(item)
        if waiting:
            best = min(waiting, key=lambda w: (w["p"], w["o"]))
            waiting.remove(best)
            said[best["key"]] = now
            out.append((now, best["seq"]))
    return out


@dataclass
class Thresholds:
    history: int = 6
    minimum_samples: int = 3
    minimum_span_s: float = 0.25
    warning_s: float = 3.5
    imminent_s: float = 1.5
    minimum_area: float = 0.005
    minimum_consistency: float = 0.75
    repeat_s: float = 2.0
    minimum_confidence: float = 0.35


def approach(rows, p):
    """rows: (frame, time, area, confidence, in_path, moving) -> emissions."""
    samples, level, at, count, last, out = [], None, None, 0, None, []
    for frame, now, area, confidence, in_path, moving in rows:
        if last is not None and frame != last + 1:
            samples, level, at, count = [], None, None, 0
        last = frame
        if area <= 0:
            continue
        if samples and math.isclose(samples[-1][0], now):
            samples[-1] = (now, area)
        else:
            samples = (samples + [(now, area)])[-p.history :]
        if area < p.minimum_area or len(samples) < p.minimum_samples:
            continue
        span = now - samples[0][0]
        if span < p.minimum_span_s:
            continue
        rate = (math.log(area) - math.log(samples[0][1])) / span
        steady = sum(b[1] > a[1] for a, b in zip(samples, samples[1:])) / (len(samples) - 1)
        if rate <= 0 or steady < p.minimum_consistency or 2 / rate > p.warning_s:
            continue
        now_level = "IMMINENT" if 2 / rate <= p.imminent_s else "WARNING"
        if now_level == "WARNING" and not (in_path and moving):
            continue
        if confidence * steady < p.minimum_confidence:
            continue
        if level is None or (level, now_level) == ("WARNING", "IMMINENT") or now - at >= p.repeat_s:
            level, at, count = now_level, now, count + 1
            out.append((frame, now_level, count))
    return out


def motion(rows, window=9, minimum=0.3, gap=2, n=2):
    """rows: (frame, box, confidence) -> (frame, motion, confidence, previous)."""
    import statistics as st

    history, last, weak = [], None, 0
    candidate, confirmed, out = [], None, []
    for frame, box, confidence in rows:
        if last is not None and not 0 <= frame - last - 1 <= gap:
            history, candidate, confirmed, weak = [], [], None, 0
        last = frame
        w, h = box[2] - box[0], box[3] - box[1]
        if w <= 0 or h <= 0:
            history, candidate, confirmed, weak = [], [], None, 0
            out.append((frame, "UNKNOWN", 0.0, None))
            continue
        if confidence < minimum:
            weak += 1
            if weak > gap:
                history, candidate, confirmed = [], [], None
            out.append((frame, "UNKNOWN", 0.0, None))
            continue
        weak = 0
        item = (w * h, (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, w, h, confidence)
        history = (history + [item])[-window:]
        state, evidence = "UNKNOWN", 0.0
        if len(history) == window:
            k = max(1, window // 3)
            med = lambda part, i: st.median(x[i] for x in part)
            first, end = history[:k], history[-k:]
            mw, mh = (sum(x[i] for x in history) / window for i in (3, 4))
            change = (med(end, 0) - med(first, 0)) / med(first, 0)
            dx, dy = (med(end, 1) - med(first, 1)) / mw, (med(end, 2) - med(first, 2)) / mh
            steps = [(b[0] - a[0]) / a[0] for a, b in zip(history, history[1:])]
            up = sum(s >= -0.02 for s in steps) / len(steps)
            down = sum(s <= 0.02 for s in steps) / len(steps)
            strength = 0.0
            if up >= 0.65 and change >= 0.1 and math.hypot(dx, dy) <= 1.25 and dy >= -0.12:
                state, strength = "APPROACHING", min(1.0, change / 0.2)
            elif down >= 0.65 and change <= -0.1 and math.hypot(dx, dy) <= 1.25 and dy <= 0.12:
                state, strength = "RECEDING", min(1.0, -change / 0.2)
            else:
                areas = [x[0] for x in history]
                spread = (max(areas) - min(areas)) / (sum(areas) / window)
                far = max(
                    math.hypot((x[1] - history[0][1]) / mw, (x[2] - history[0][2]) / mh)
                    for x in history
                )
                if spread <= 0.03 and far <= 0.08:
                    calm = min(1 - spread / 0.03, 1 - far / 0.08)
                    state, strength = "STOPPED", 0.5 + 0.5 * max(0.0, calm)
            if state != "UNKNOWN":
                evidence = sum(x[5] for x in history) / window * (0.5 + 0.5 * strength)
        if state == "UNKNOWN":
            candidate = []
            out.append((frame, "UNKNOWN", 0.0, None))
        elif state == confirmed:
            candidate = []
            out.append((frame, state, evidence, None))
        else:
            if candidate and candidate[0][0] != state:
                candidate = []
            candidate.append((state, evidence))
            if len(candidate) < n:
                out.append((frame, "UNKNOWN", 0.0, None))
            else:
                mean = sum(e for _, e in candidate) / len(candidate)
                out.append((frame, state, mean, confirmed))
                confirmed, candidate = state, []
    return out


def routes(reads, n):
    """reads: (order, route, confidence) -> (order, route, mean) where confirmed."""
    current, streak, out = None, [], []
    for order, route, confidence in reads:
        if route is None:
            current, streak = None, []
            continue
        streak = streak + [confidence] if route == current else [confidence]
        current = route
        if len(streak) >= n:
            out.append((order, route, sum(streak) / len(streak)))
    return out
