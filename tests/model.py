"""Small sequential models of the operators, for comparison on little inputs."""

import hashlib
import heapq
import math

import numpy as np


def score(a, b, metric="l2"):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float(((a - b) ** 2).sum()) if metric == "l2" else float(-(a * b).sum())


def frame(spark, vectors, ids=None, name="vec_id"):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{name} bigint, v array<float>")


def topk(points, queries, k, metric="l2", exclude_self=False):
    out = {}
    for q, v in queries.items():
        near = sorted((score(v, w, metric), i) for i, w in points.items() if not (exclude_self and i == q))
        out[q] = [i for _, i in near[:k]]
    return out


def _hash_order(ids, seed, inner):
    label = f"{inner}:" if inner else ""
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{label}{i}".encode()).hexdigest(), i))


def carve_tree(points, params, replica=0):
    """Nested nodes {path, rep, ids, children} of one replica."""

    def leaders(n):
        share = int(np.float32(n) * np.float32(params.leader_frac))
        return min(max(2, share), params.max_leaders, n)

    def grow(ids, path, rep):
        node = {"path": path, "rep": rep, "ids": ids, "children": []}
        if len(ids) <= params.cmax:
            return node
        chosen = _hash_order(ids, params.seed + replica, path[8:])[: leaders(len(ids))]
        buckets = {}
        for i in ids:
            best = min((score(points[i], points[l], params.metric), l) for l in chosen)[1]
            buckets.setdefault(chosen.index(best), []).append(i)
        for number in sorted(buckets):
            members = buckets[number]
            if len(members) == len(ids):
                for c in range(0, len(members), params.cmax):
                    run = members[c : c + params.cmax]
                    node["children"].append(
                        {"path": path + f"{c // params.cmax:08x}", "rep": run[0], "ids": run,
                         "children": [], "chunk": True}
                    )
            else:
                node["children"].append(grow(members, path + f"{number:08x}", chosen[number]))
        return node

    ids = sorted(points)
    return grow(ids, f"{replica:08x}", ids[0])


def leaves_of(tree):
    if not tree["children"]:
        return [tree]
    return [leaf for child in tree["children"] for leaf in leaves_of(child)]


def partition(points, params, replica=0):
    """Leaves as sorted id lists, overlap included, in leaf order."""
    tree = carve_tree(points, params, replica)
    leaves = leaves_of(tree)
    members = [list(leaf["ids"]) for leaf in leaves]
    if params.fanout > 1 and tree["children"]:
        where = {leaf["path"]: n for n, leaf in enumerate(leaves)}
        home = {i: n for n, leaf in enumerate(leaves) for i in leaf["ids"]}

        def nearest(i, children, count):
            return heapq.nsmallest(
                count, children, key=lambda c: (score(points[i], points[c["rep"]], params.metric), c["rep"])
            )

        for i in points:
            taken = 0
            for child in nearest(i, tree["children"], params.fanout):
                while child["children"]:
                    child = nearest(i, child["children"], 1)[0]
                leaf = where[child["path"]]
                if leaf != home[i] and taken < params.fanout - 1:
                    members[leaf].append(i)
                    taken += 1
    return [sorted(set(m)) for m in members]


def shortlist(leaves, i, cap=0):
    out = []
    for leaf in leaves:
        if i in leaf:
            out += [j for j in leaf if j != i and j not in out]
    return out[:cap] if cap else out


def bucket_scan(rows, max_degree):
    """Scan (d, id, hash) rows in order; returns counters and the final ids."""
    table, kept, replaced, evicted, dropped = {}, 0, 0, 0, 0
    for d, i, code in rows:
        if code in table:
            if (d, i) < table[code]:
                table[code] = (d, i)
                kept, replaced = kept + 1, replaced + 1
            else:
                dropped += 1
        elif len(table) < max_degree:
            table[code] = (d, i)
            kept += 1
        else:
            far = max(table, key=lambda c: table[c]) if table else None
            if far is not None and (d, i) < table[far]:
                del table[far]
                table[code] = (d, i)
                kept, evicted = kept + 1, evicted + 1
            else:
                dropped += 1
    return (kept, replaced, evicted, dropped), [i for _, i in sorted(table.values())]


def best_first(points, nbrs, query, beam, topk, entry=0, metric="l2"):
    queue, seen, expanded = [(score(points[entry], query, metric), entry)], {entry}, []
    while queue and len(expanded) < beam:
        d, node = heapq.heappop(queue)
        expanded.append((d, node))
        for other in nbrs.get(node, []):
            if other not in seen:
                seen.add(other)
                heapq.heappush(queue, (score(points[other], query, metric), other))
    return [i for _, i in sorted(expanded)[:topk]]


def close(a, b, tolerance=1e-9):
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
