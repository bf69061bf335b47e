"""Plain Python counterparts of the operators SQL cannot express."""

from __future__ import annotations

import math

import numpy as np


def leader(vectors, threshold):
    """(owner, similarity) of each vector: leaders in order, then the best leader of the rest."""
    rows = [np.asarray(v, float) / np.linalg.norm(v) for v in vectors]
    leaders = []
    for i, v in enumerate(rows):
        if all(round(float(v @ rows[j]), 9) <= threshold for j in leaders):
            leaders.append(i)
    out = []
    for i, v in enumerate(rows):
        if i in leaders:
            out.append((i, None))
        else:
            sim, j = max(((round(float(v @ rows[j]), 9), -j) for j in leaders))
            out.append((-j, sim))
    return out


def gamma_cdf(a, x):
    if x <= 0:
        return 0.0
    if a > 1500:  # midpoint integration of the density in the standardised variable
        lo, hi = max(0.0, a - 14 * math.sqrt(a)), x
        t = np.linspace(lo, hi, 400_001)
        mid = (t[1:] + t[:-1]) / 2
        dens = np.exp((a - 1) * np.log(mid) - mid - math.lgamma(a))
        return float(dens.sum() * (t[1] - t[0]))
    total, term, n = 0.0, 1.0, 0
    while n < x + 20 * math.sqrt(x) + 100:
        total += term
        n += 1
        term *= x / (a + n)
    return min(1.0, math.exp(a * math.log(x) - x - math.lgamma(a + 1)) * total)


def overlap_links(clusters, threshold):
    """Links among {id: [posts]} of one window, repeats in the smaller side counted."""
    ids = sorted(clusters)
    out = {}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, big = (a, b) if len(clusters[a]) < len(clusters[b]) else (b, a)
            common = [p for p in clusters[small] if p in set(clusters[big])]
            ratio = len(common) / len(clusters[small])
            if ratio > threshold:
                out[(small, big)] = round(ratio, 9)
    return out


def modularity(edges, part):
    m = sum(w for _, _, w in edges)
    deg, inside = {}, {}
    for a, b, w in edges:
        deg[part[a]] = deg.get(part[a], 0) + w
        deg[part[b]] = deg.get(part[b], 0) + w
        if part[a] == part[b]:
            inside[part[a]] = inside.get(part[a], 0) + w
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in deg.items())


def greedy_communities(edges):
    """One-node-at-a-time modularity ascent with contraction."""
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    final = {n: n for n in nodes}
    cur = list(edges)
    while True:
        ids = sorted({n for a, b, _ in cur for n in (a, b)})
        k = {n: 0.0 for n in ids}
        adj = {n: {} for n in ids}
        m2 = 0.0
        for a, b, w in cur:
            k[a] += w
            k[b] += w
            m2 += 2 * w
            if a != b:
                adj[a][b] = adj[a].get(b, 0) + w
                adj[b][a] = adj[b].get(a, 0) + w
        comm, tot = {n: n for n in ids}, dict(k)
        moved_any, moved = False, True
        while moved:
            moved = False
            for n in ids:
                own = comm[n]
                tot[own] -= k[n]
                links = {own: 0.0}
                for o, w in adj[n].items():
                    links[comm[o]] = links.get(comm[o], 0) + w
                best = max(sorted(links), key=lambda c: (links[c] - tot[c] * k[n] / m2, c == own))
                if links[best] - tot[best] * k[n] / m2 <= links[own] - tot[own] * k[n] / m2 + 1e-12:
                    best = own
                comm[n] = best
                tot[best] += k[n]
                moved |= best != own
                moved_any |= best != own
        if not moved_any:
            return final
        final = {n: comm[c] for n, c in final.items()}
        merged = {}
        for a, b, w in cur:
            key = tuple(sorted((comm[a], comm[b])))
            merged[key] = merged.get(key, 0) + w
        cur = [(a, b, w) for (a, b), w in merged.items()]
