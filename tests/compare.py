"""Rows of two results as sorted lists of strings, and clone groups pair by pair."""

import collections
import numbers

import pandas as pd


def cell(v):
    if pd.isna(v):
        return ""
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def clone_groups(files, size, least_lines):
    """(type, tokens, instances) of all groups, from all pairs of equal windows of {path: [(norm, raw, kind, line, end)]}."""
    windows = {}
    for p, t in files.items():
        for s in range(len(t) - size + 1):
            w = t[s : s + size]
            kinds = [x[2] for x in w]
            if w[-1][4] - w[0][3] + 1 >= least_lines and kinds.count("delimiter") / size <= 0.75 and sum(k in ("keyword", "identifier", "literal") for k in kinds) >= 5:
                windows[p, s] = tuple(x[0] for x in w)
    by, before, last = collections.defaultdict(list), {}, {}
    for p, s in sorted(windows):
        by[windows[p, s]].append((p, s))
        before[p, s], last[p] = last.get(p), s
    norm = {p: [x[0] for x in t] for p, t in files.items()}
    groups = collections.defaultdict(set)
    for places in by.values():
        for i, (p, s) in enumerate(places):
            for q, u in places[i + 1 :]:
                if p == q and u - s < size / 2:
                    continue
                a, b = before[p, s], before[q, u]
                if a is not None and b is not None and s - a == u - b and norm[p][a:s] == norm[q][b:u]:
                    continue
                n = size
                while s + n < len(norm[p]) and u + n < len(norm[q]) and norm[p][s + n] == norm[q][u + n]:
                    n += 1
                groups[tuple(norm[p][s : s + n])] |= {(p, s), (q, u)}
    out = []
    for key, places in groups.items():
        n, kept = len(key), []
        for p, a, b in sorted((p, files[p][s][3], files[p][s + n - 1][4]) for p, s in places):
            if not any(k[0] == p and abs(k[1] - a) <= 2 and abs(k[2] - b) <= 2 for k in kept):
                kept.append((p, a, b))
        if len(kept) > 1:
            out.append(("TYPE_1" if len({tuple(x[1] for x in files[p][s : s + n]) for p, s in places}) == 1 else "TYPE_2", n, kept))
    return out
