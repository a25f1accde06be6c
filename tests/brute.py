"""Plain-Python versions of the operators, written from the definitions, for small inputs."""

from __future__ import annotations

import math
from collections import defaultdict
from datetime import datetime, timedelta, timezone

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
LOG_SCHEMA = (
    "query_id long, text string, ts timestamp, is_interactive boolean, is_suspicious boolean, user_id long"
)


def at(seconds: float) -> datetime:
    return EPOCH + timedelta(microseconds=round(seconds * 1e6))


def us(ts: datetime) -> int:
    return (ts - EPOCH) // timedelta(microseconds=1)


def log_frame(spark, rows):
    """Rows of (query_id, text, seconds, is_interactive, is_suspicious, user_id) as a query table."""
    return spark.createDataFrame(
        [(q, t, None if s is None else at(s), i, b, u) for q, t, s, i, b, u in rows], LOG_SCHEMA
    )


def _by_user(rows, drop_suspicious):
    users = defaultdict(list)
    for q, _, s, interactive, suspicious, user in rows:
        if interactive and s is not None and user is not None and not (drop_suspicious and suspicious):
            users[user].append((round(s * 1e6), q))
    return {user: sorted(points) for user, points in users.items()}


def session_of_query(rows, gap_s=1800.0, drop_suspicious=True):
    """query_id -> (user, session_seq, delta in microseconds)."""
    found = {}
    for user, points in _by_user(rows, drop_suspicious).items():
        seq, previous = 0, points[0][0]
        for t, q in points:
            if t - previous > round(gap_s * 1e6):
                seq += 1
            found[q] = (user, seq, t - previous)
            previous = t
    return found


def groups(rows):
    """query_id -> (copies, copies of this user, distinct users, intervals, entropy, consistency, clockness)."""
    interactive = [r for r in rows if r[3]]
    by_text, by_key = defaultdict(list), defaultdict(list)
    for r in interactive:
        by_text[r[1]].append(r)
        by_key[r[1], r[5]].append(r)
    out = {}
    for (text, _), copies in by_key.items():
        times = sorted(round(r[2] * 1e6) for r in copies)
        gaps = [b - a for a, b in zip(times, times[1:])]
        values = (
            len(by_text[text]),
            len(copies),
            len({r[5] for r in by_text[text]}),
            len(gaps),
            entropy(gaps),
            consistency(gaps),
            clockness(gaps),
        )
        for r in copies:
            out[r[0]] = values
    return out


def entropy(gaps_us):
    if len(gaps_us) <= 1:
        return 0.0
    counts = defaultdict(int)
    for gap in gaps_us:
        if gap <= 10**12:
            counts[min(gap // 10**8, 9999)] += 1
    total = sum(counts.values())
    if total == 0:
        return None
    return -sum((n / (total * 100)) * math.log(n / (total * 100) + 1e-4) for n in counts.values())


def consistency(gaps_us):
    if len(gaps_us) <= 1:
        return 1.0
    mean = sum(gaps_us) / len(gaps_us)
    return sum(1 for g in gaps_us if mean and 0.9 < g / mean < 1.1) / len(gaps_us)


def clockness(gaps_us):
    if not gaps_us:
        return -1.0
    off = [min(g % 30_000_000, 30_000_000 - g % 30_000_000) for g in gaps_us]
    return 1 - sum(off) / len(off) / 30_000_000


def lex(text):
    """Segments of a text: marks, and runs as lists of (atom kind, atom); None when a quote stays open."""
    segments, run, i = [], [], 0

    def close_run():
        if any(atom.strip() for _, atom in run):
            segments.append(list(run))
        run.clear()

    while i < len(text):
        c = text[i]
        if c in "|[]":
            close_run()
            segments.append(c)
            i += 1
            continue
        if c == '"':
            j = i + 1
            while j < len(text) and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            if j >= len(text):
                return None
            run.append(("quoted", text[i : j + 1]))
            i = j + 1
        elif c == "`":
            j = text.find("`", i + 1)
            if j < 0:
                return None
            run.append(("macro", text[i : j + 1]))
            i = j + 1
        else:
            j = i
            while j < len(text) and text[j] not in '|[]"`':
                j += 1
            run.append(("plain", text[i:j]))
            i = j
    close_run()
    depth = 0
    for s in segments:
        depth += (s == "[") - (s == "]")
        if depth < 0:
            return None
    return segments if depth == 0 else None


def _atoms(run):
    return [atom.strip() for _, atom in run if atom.strip()]


def split_stages(text):
    segments = lex(text)
    if segments is None:
        return None
    out, current, depth = [], [], 0
    for s in segments:
        if s == "|" and depth == 0:
            if current:
                out.append(" ".join(current))
            current = ["|"]
            continue
        current += [s] if isinstance(s, str) else _atoms(s)
        depth += (s == "[") - (s == "]")
        if s == "]" and depth == 0:
            out.append(" ".join(current))
            current = []
    if current:
        out.append(" ".join(current))
    return out


def commands(text):
    segments = lex(text)
    if segments is None:
        return None
    out, previous = [], "|"
    for s in segments:
        if not isinstance(s, str) and previous in ("|", "["):
            first = next(a for a in _atoms(s))
            out.append((first if first[0] in '"`' else first.split()[0]).lower())
        previous = s if isinstance(s, str) else "run"
    return out


def stage_texts(text):
    """(depth, source text) of every stage by where it starts, by recursive descent."""
    segments = lex(text)
    if segments is None:
        return None
    source = [s if isinstance(s, str) else "".join(a for _, a in s) for s in segments]
    out = []
    for k, s in enumerate(segments):
        if isinstance(s, str) or not (k == 0 or segments[k - 1] in ("|", "[")):
            continue
        depth, end = 0, k
        while end < len(segments):
            if depth == 0 and segments[end] in ("|", "]"):
                break
            depth += (segments[end] == "[") - (segments[end] == "]")
            end += 1
        level = sum((x == "[") - (x == "]") for x in segments[:k])
        out.append((level, source, k, end))
    return [(level, "".join(src[a:b])) for level, src, a, b in out]
