"""Plain reading of the drift rules over a list of lines, for comparison."""

import re

MISSING = {"", "na", "nan", "-"}


def clean(x):
    return x.strip(" \t\r\n\f\xa0\"'﻿")


def kind(values):
    if all(re.fullmatch(r"[+-]?\d+", v) for v in values):
        return "integer"
    if all(re.fullmatch(r"[+-]?(\d+([.,]\d*)?|[.,]\d+)", v) for v in values):
        return "decimal"
    return "text"


def changes(lines, field_of):
    """lines: (rig, log_seq, line_no, line, arrived_at); field_of: spelling -> proper name or None."""
    logs = {}
    for rig, seq, no, line, at in sorted(lines, key=lambda r: (str(r[0]), r[1], r[2], r[4])):
        logs.setdefault((rig, seq), {})
        logs[rig, seq].setdefault(no, line or "")
    out, last, prev = set(), {}, {}
    for (rig, seq), by_no in sorted(logs.items()):
        if 0 not in by_no:
            continue
        sep = max("\t;|,", key=by_no[0].count)
        names = [clean(x) for x in by_no[0].split(sep)]
        at = {}
        for i, n in enumerate(names):
            f = field_of(n)
            if f and f not in at:
                at[f] = i
        now = {f: names[i] for f, i in at.items()}
        if rig in prev:
            was = prev[rig]
            out |= {(rig, seq, f, "added") for f in now.keys() - was.keys()} | {(rig, seq, f, "removed") for f in was.keys() - now.keys()}
            out |= {(rig, seq, f, "renamed") for f in now.keys() & was.keys() if now[f] != was[f]}
        prev[rig] = now
        rows = [[clean(x) for x in line.split(sep)] for no, line in by_no.items() if no > 0]
        rows = [r for r in rows if [x.lower() for x in r] != [x.lower() for x in names]]
        for f, i in at.items():
            vals = [r[i] for r in rows if i < len(r) and r[i].lower() not in MISSING]
            if vals:
                t = kind(vals)
                if last.get((rig, f), t) != t:
                    out.add((rig, seq, f, "retyped"))
                last[rig, f] = t
    return out


def table(lines, field_of, fields):
    """(rig, log_seq, line_no) -> {field: value as written} of every data line with a known, given value; first deliveries."""
    heads, rows = {}, {}
    for rig, seq, no, line, at in sorted((x for x in lines if None not in x[:3]), key=lambda r: (str(r[0]), r[1], r[2], r[4])):
        if no == 0:
            heads.setdefault((rig, seq), line or "")
        else:
            rows.setdefault((rig, seq, no), line or "")
    out = {}
    for (rig, seq, no), line in rows.items():
        if (rig, seq) not in heads:
            continue
        sep = max("\t;|,", key=heads[rig, seq].count)
        names, vals = ([clean(x) for x in t.split(sep)] for t in (heads[rig, seq], line))
        if [x.lower() for x in names] == [x.lower() for x in vals]:
            continue
        got = {}
        for n, v in zip(names, vals, strict=False):
            f = field_of(n)
            if f in fields and f not in got:
                got[f] = v
        got = {f: v for f, v in got.items() if v.lower() not in MISSING}
        if got:
            out[rig, seq, no] = got
    return out


def seconds(v):
    """Seconds of the day of a time however written, None if it is none."""
    m = re.fullmatch(r"(\d{1,2})(?:[:.h])(\d{2})(?:[:.m])(\d{2})s?", v) or re.fullmatch(r"(\d{2})(\d{2})(\d{2})", v)
    if m:
        h, mi, s = map(int, m.groups())
        return h * 3600 + mi * 60 + s
    return int(float(v.replace(",", ".")) + 0.5) if re.fullmatch(r"\d{1,5}[.,]\d*", v) else None


def number(v):
    try:
        return float(re.sub(r"\s*[A-Za-z%°]+$", "", v).replace(",", "."))
    except ValueError:
        return None
